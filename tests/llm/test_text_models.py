"""Decontamination, quality, toxicity and licences against brute force and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import decontaminate, licenses, quality, toxicity, words
from tallyloom.llm.queries import op4_quality, op6_toxicity

SF = "/root/testdata/sf0.01"


# ---- decontamination -----------------------------------------------------------

def bm25_index(items, threshold=decontaminate.THRESHOLD):
    lower = words.lettered()
    frequency, total = Counter(), 0
    for _, t in items:
        h = words.hash_words([t], lower)[0]
        frequency.update(set(h.tolist()))
        total += len(h)
    return decontaminate.build_index([i for i, _ in items], [t for _, t in items], len(items), frequency, total / len(items), threshold)


@pytest.mark.parametrize("threshold", [0.05, 0.2, 0.5])
def test_wand_finds_all_above_threshold(monkeypatch, threshold):
    monkeypatch.setattr(decontaminate, "BLOCK", 2)
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, [1 / (1 + j) for j in range(60)], k=rng.randint(3, 15)))) for i in range(80)]
    index = bm25_index(items, threshold)
    for _ in range(60):
        query = np.unique(rng.choices(range(len(index.terms)), k=rng.randint(1, 25)))
        scores = np.zeros(len(items))
        for t in query:
            own = slice(index.starts[t], index.starts[t + 1])
            scores[index.items[own]] += index.impacts[own]
        want = {int(i): scores[i] for i in np.flatnonzero(scores >= threshold - 1e-9)}
        got = dict(decontaminate.wand(index, query, threshold))
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in got)


def test_every_passage_is_searched(spark):
    """The pivot test skips no passage that the plain score of every window would keep."""
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    index, lower = bm25_index(items), words.lettered()
    want = set()
    for d, hashes in enumerate(words.hash_words(texts, lower)):
        at = np.searchsorted(index.terms, hashes).clip(max=len(index.terms) - 1)
        for a in range(0, max(1, len(hashes)), index.window):
            own, part = at[a:a + 2 * index.window], hashes[a:a + 2 * index.window]
            scores = np.zeros(len(items))
            for t in set(own[index.terms[own] == part].tolist()):
                p = slice(index.starts[t], index.starts[t + 1])
                scores[index.items[p]] += index.impacts[p]
            near = hashes[max(0, a - index.window):a + 3 * index.window]
            for i in np.flatnonzero(scores >= 0.5):
                if min(decontaminate._share(index.questions[i], near), decontaminate._share(index.answers[i], near)) >= 0.5:
                    want.add((d, int(i)))
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    _, _, hashes, bounds = words.words(data, offsets, lower)
    assert {(r, i) for r, i, *_ in decontaminate._hits(index, hashes, bounds, 0.5, 0.5)} == want and want


def test_planted_passages_are_found_and_others_left(spark, docs, empty):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    table = spark.read.parquet(f"{SF}/documents.parquet")
    want = {(r["doc_id"], r["item_id"]) for r in table.join(items.withColumnRenamed("text", "item"), F.expr("contains(text, item)")).collect()}
    got = decontaminate.contamination(table, items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want
    left = decontaminate.drop_contaminated(table, items)
    assert left.columns == table.columns and {r["doc_id"] for r in table.select("doc_id").subtract(left.select("doc_id")).collect()} == {d for d, _ in want}
    assert decontaminate.contamination(docs, items).count() == 0 and decontaminate.drop_contaminated(docs, items).count() == docs.count()
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(table, items.where("1 = 0")).columns == got.columns


def test_items_with_nulls_repeats_and_string_ids(spark):
    text = "Which river runs through the old town of Brezna? The Mirna runs through it from east to west."
    items = spark.createDataFrame([("a", text), ("a", text), ("b", None), (None, text), ("c", "")], "item_id string, text string")
    df = spark.createDataFrame([(1, "noise " * 200 + text.upper() + " noise" * 300), (1, text), (2, text.split("?")[0]), (None, text), (3, None), (4, "")], "doc_id long, text string")
    got = decontaminate.contamination(df, items).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"]) for r in got) == [(-1, "a"), (1, "a"), (1, "a")]


def test_index_in_parts(spark, monkeypatch):
    items, table = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "documents"))
    want = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(table, items).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 3000)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(table, items).collect()} == want


# ---- quality and toxicity ------------------------------------------------------

def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def auc(scores, labels):
    order = np.argsort(np.argsort(scores)) + 1
    positive = np.array(labels) == 1
    return (order[positive].sum() - positive.sum() * (positive.sum() + 1) / 2) / (positive.sum() * (~positive).sum())


def test_quality_on_the_held_out_fold(spark):
    rows = {r["doc_id"]: r for r in op4_quality(spark, "/root/testdata/sf0.1").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    assert all(r["held_out"] == held_out(i) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in rows.items())
    own = [(rows[i]["score"], q) for i, q in labels if held_out(i)]
    assert auc(*zip(*own, strict=True)) > 0.97
    assert np.mean([(s >= 0.7) == q for s, q in own]) > 0.95


def test_quality_edges(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1), (-5, 0), (-6, None)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs.withColumnRenamed("k", "score"), model)
    assert scored.columns == [*[c for c in docs.columns if c != "k"], "score"] and {r["score"] for r in scored.collect()} == {0.5}
    assert quality.score_quality(empty, model).count() == 0
    ids = [r["doc_id"] for r in docs.collect()]
    one = quality.fit_quality(docs, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int"))
    assert 0.9 < quality.score_quality(docs, one).first()["score"] < 1


def test_trees_as_arrays_follow_each_row():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit_trees(x, y, trees=30)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        total = model.start
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            total += v[at - len(f)]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_toxicity_on_the_held_out_fold(spark):
    rows = {r["doc_id"]: r for r in op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()]
    own = [(rows[i], t) for i, t in labels if held_out(i)]
    assert auc([r["severity"] for r, _ in own], [t for _, t in own]) > 0.97
    assert np.mean([r["toxic"] == bool(t) for r, t in own]) > 0.97
    assert all(0 <= r["severity"] <= toxicity.GRADES and 0 <= r["grade"] <= toxicity.GRADES for r in rows.values())


def test_toxicity_edges(spark, docs, empty):
    labels = spark.createDataFrame([(None, 1), (-5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    got = toxicity.score_toxicity(docs, model)
    assert got.count() == docs.count() and got.columns == ["doc_id", "severity", "p_toxic", "grade", "toxic"]
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_ordinal_fit_recovers_weights_and_ordered_cuts():
    rng = np.random.default_rng(8)
    n, terms = 6000, 6
    x = rng.random((n, terms)) * (rng.random((n, terms)) < 0.4)
    true, cuts = np.array([2.0, -1.5, 1.0, 0.0, 3.0, -3.0]), np.array([0.5, 1.5, 3.0])
    u = rng.logistic(size=n)
    grade = ((x @ true + u)[:, None] > cuts[None, :]).sum(axis=1)
    row, term = np.nonzero(x)
    weights, found = toxicity.fit_ordinal(row, term, x[row, term], grade, terms, steps=800, ridge=0)
    assert abs(weights - true).max() < 0.45 and abs(found - cuts).max() < 0.25 and (np.diff(found) > 0).all()


# ---- licences ------------------------------------------------------------------

def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(found)) if found[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses_against_plain_search(spark, texts, empty):
    rng = random.Random(1)
    lines = ["Released under the MIT License.", "All rights reserved.", "CC BY 4.0", "the General Public License", "all rights reserved all rights", "cc by cc by", "general public", "ALL-RIGHTS_reserved"]
    made = [" ".join(rng.choices([*lines, "the software", "une licence é", "free of charge to any"], k=rng.randint(0, 9))) for _ in range(200)]
    rows = list(enumerate([*texts, *made]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty).count() == 0


def test_templates_give_their_label(spark):
    rows = [(label, "Some words ahead. " + text + " And some behind.") for label, text in licenses.TEMPLATES.items()]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert all(label in r["labels"].split(",") for label, r in got.items())
    span = next(s for s in got["mit"]["spans"] if s["label"] == "mit")
    assert span["first_word"] == 3 and span["end_word"] - 3 == span["covered"] == len(re.findall(r"[a-z0-9]+", licenses.TEMPLATES["mit"].lower()))


CLAUSES = {
    "mit": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "bsd": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "apache-2.0": [
        "You must cause any modified files to carry prominent notices stating that You changed the files",
        "See the License for the specific language governing permissions and limitations under the License."],
    "gpl": [
        "You may convey verbatim copies of the Program's source code as you receive it, in any medium, provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice",
        "If the disclaimer of warranty and limitation of liability provided above cannot be given local legal effect according to their terms, reviewing courts shall apply local law that most closely approximates an absolute waiver of all civil liability"],
    "cc-by": [
        "Every recipient of the Licensed Material automatically receives an offer from the Licensor to exercise the Licensed Rights under the terms and conditions of this Public License.",
        "Nothing in this Public License constitutes or may be interpreted as a limitation upon, or waiver of, any privileges and immunities that apply to the Licensor or You"],
    "mpl-2.0": [
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0."],
    "lgpl": ["You may convey a covered work under sections 3 and 4 of this License without being bound by section 3 of the GNU GPL."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"],
    "zlib": ["This notice may not be removed or altered from any source distribution."],
    "unlicense": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
    "cc0": ["No trademark or patent rights held by Affirmer are waived, abandoned, surrendered, licensed or otherwise affected by this document."],
}


def test_middle_and_last_clauses_give_label_and_span(spark):
    rows = [(f"{label}/{i}", f"Qwx zvb. {clause} Qwx zvb.") for label, own in CLAUSES.items() for i, clause in enumerate(own)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    for key, text in rows:
        label, n = key.split("/")[0], len(re.findall("[a-z0-9]+", text.lower()))
        assert label in got[key]["labels"].split(",") and got[key]["score"] > 0, key
        assert any((s["label"], s["first_word"], s["end_word"]) == (label, 2, n - 2) for s in got[key]["spans"]), key


def test_a_whole_file_is_one_span_to_its_end(spark):
    notice = "Copyright (c) 2019 Qwx Zvb\n\n"
    mit = licenses.TEMPLATES["mit"].split("----")[0].split("Released under the MIT License. ")[1]
    bsd = licenses.TEMPLATES["bsd"].split("----")[0]
    rows = [("mit", notice + mit), ("bsd", notice + bsd)]
    for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        assert ("OTHER DEALINGS" in mit and "POSSIBILITY OF" in bsd) and r["labels"] == r["doc_id"]
        assert max(s["end_word"] for s in r["spans"]) == r["n_words"]


def test_phrase_of_one_word(spark):
    df = spark.createDataFrame([(1, "qwx proprietary zvb"), (2, "qwx zvb"), (3, "Proprietary")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, phrases={"proprietary": "closed"}).collect()}
    assert [(got[i]["n_base"], got[i]["first_word"], got[i]["labels"]) for i in (1, 2, 3)] == [(1, 1, "closed"), (0, None, ""), (1, 0, "closed")]


def test_everyday_phrases_give_no_label(spark):
    clean = [
        "Please bring a copy of the letter with you.", "You may not use the lift.", "The house was built in compliance with the rules.",
        "The rent is paid under the terms of the lease.", "The car is sold as is without warranty of any kind.",
        "You may not use a copy of the key in compliance with the rules under the terms of the lease, unless required by applicable law or agreed to in writing.",
        "A bonus is paid provided that the following conditions are met, free of charge to any person, with or without modification, at your option.",
        "To the extent permitted by applicable law, parking is free. All of the terms and conditions of this offer apply.",
    ]
    named = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0": "apache-2.0", "Licensed under the BSD License": "bsd",
        "Subject to the terms of the Mozilla Public License": "mpl-2.0", "licensed under a Creative Commons Attribution 4.0 International License": "cc-by"}
    rows = [*[(t, t) for t in clean], *[(t, t) for t in named]]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert {t: got[t]["labels"] for t in clean if got[t]["labels"] or got[t]["score"] or got[t]["spans"]} == {}
    assert all(label in got[t]["labels"].split(",") for t, label in named.items())


def test_short_templates_of_the_caller(spark):
    df = spark.createDataFrame([(1, "qwx these notes belong to zvb"), (2, "qwx these notes belong zvb")], "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df, templates={"notes": "These notes belong to"}, phrases={}).collect()}
    assert got == {1: "notes", 2: ""}


def test_matching_statistics_are_longest_matches():
    rng = random.Random(6)
    sequences = [[rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(6)]
    automaton = licenses.Automaton()
    for i, s in enumerate(sequences):
        automaton.add(s, str(i))
    automaton.finish({})

    def inside(part, whole):
        return any(whole[i:i + len(part)] == part for i in range(len(whole) - len(part) + 1))

    for _ in range(50):
        run = [rng.randrange(4) for _ in range(30)]
        for i, (n, state) in enumerate(automaton.statistics(run)):
            best = max(m for m in range(i + 2) if any(inside(run[i + 1 - m:i + 1], s) for s in sequences))
            assert n == best
            if n:
                assert automaton.owners[state] == {str(j) for j, s in enumerate(sequences) if inside(run[i + 1 - n:i + 1], s)}
