"""SQL texts that are too long for the list of queries; put together from one piece per level."""

from __future__ import annotations

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(text: str) -> str:
    return f"translate({text}, '{A_TO_Z}', '{A_TO_Z.lower()}')"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: its bits, eight a character, pass the register one by one."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(r, x) & 1 = 1 THEN xor(xor(r, x) >> 1, 3988292384) ELSE xor(r, x) >> 1 END"
    return f"xor(list_reduce({bits}, lambda r, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _field(value: str) -> str:
    text = f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def merkle_manifest(levels: int = 7, arity: int = 16) -> str:
    """Trees of up to 16^levels nodes; a tree with one node stays as it is on the levels above."""
    parts = [f"""rows AS (
        SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf('text')} AS leaf,
               CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(lowered('text'))} ELSE {_leaf('text')} END AS given
        FROM documents)""", """s0 AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows)""",
             "s_n0 AS (SELECT tree, i, n, leaf AS d FROM s0)", "s_w0 AS (SELECT doc_id, tree, leaf, i, given AS f, '' AS proof FROM s0)"]

    def climb(p: str) -> None:
        for k in range(levels):
            parts.append(f"""{p}_r{k} AS (
        SELECT tree, i // {arity} AS run, max(n) AS n, list(d ORDER BY i) AS ds FROM {p}_n{k} GROUP BY tree, i // {arity})""")
            parts.append(f"""{p}_n{k + 1} AS (
        SELECT tree, run AS i, CAST(ceil(n / {arity}) AS BIGINT) AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {p}_r{k})""")
            before, after = f"array_to_string(ds[1:i % {arity}], '')", f"array_to_string(ds[i % {arity} + 2:], '')"
            before = f"CASE WHEN i % {arity} = 0 THEN '' ELSE {before} END"
            parts.append(f"""{p}_w{k + 1} AS (
        SELECT w.* EXCLUDE (i, f, proof), run AS i, CASE WHEN n > 1 THEN sha256({before} || f || {after}) ELSE f END AS f,
               CASE WHEN n > 1 THEN proof || {before} || {after} ELSE proof END AS proof
        FROM {p}_w{k} w JOIN {p}_r{k} r ON w.tree = r.tree AND i // {arity} = run)""")

    climb("s")
    parts.append(f"tops AS (SELECT tree AS of, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM s_n{levels})")
    parts.append("t_n0 AS (SELECT '' AS tree, i, n, subroot AS d FROM tops)")
    parts.append(f"t_w0 AS (SELECT doc_id, leaf, subroot, '' AS tree, o.i, f, proof FROM s_w{levels} w JOIN tops o ON w.tree = o.of)")
    climb("t")
    return "WITH " + ",\n    ".join(parts) + f"""
    SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = d AS verified FROM t_w{levels}, t_n{levels}"""


def ngram_join(k: int = 5, percent: int = 80) -> str:
    """All pairs of documents that share an n-gram, then the smallest id reachable. Words hold no blanks, so joined words are as good as lists."""
    return f"""WITH RECURSIVE worded AS (
        SELECT doc_id, coalesce(regexp_extract_all({lowered('text')}, '[^\\x20\\x09-\\x0D]+'), []) AS ws FROM documents),
    grams AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) END)) AS g
        FROM worded),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (SELECT x, y FROM shared JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE 100 * c >= {percent} * (a.n + b.n - c)),
    reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM documents
        UNION SELECT doc_id, CASE WHEN other = x THEN y ELSE x END FROM reach JOIN links ON other = x OR other = y)
    SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN sizes s ON r.doc_id = s.doc_id GROUP BY r.doc_id"""


def conversation_trie() -> str:
    """Prefixes by the digests of their turns; a subtree's sums by way of each node's smallest member."""
    return f"""WITH turns AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 100 AS base, {crc32('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM turns)),
    lent AS (SELECT v.c, b.pos AS d, b.role, b.text FROM convs v JOIN turns b ON b.c = v.base AND b.pos <= v.h),
    heads AS (SELECT c, count(*) AS n FROM lent GROUP BY c),
    rebuilt AS (
        SELECT * FROM lent
        UNION ALL SELECT t.c, pos - h + coalesce(n, 0), role, text FROM turns t JOIN convs v ON t.c = v.c LEFT JOIN heads s ON t.c = s.c WHERE pos > h),
    hashed AS (SELECT *, string_agg(md5(strlen(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY d) AS chain FROM rebuilt),
    prefixes AS (
        SELECT c, d, md5(chain) AS k, coalesce(lag(md5(chain)) OVER (PARTITION BY c ORDER BY d), '') AS p, length(text) AS chars FROM hashed
        UNION ALL SELECT c, 0, '', NULL, 0 FROM convs),
    nodes AS (SELECT d, k, any_value(p) AS p, min(c) AS low, count(*) AS n, any_value(chars) AS chars FROM prefixes GROUP BY d, k),
    kids AS (SELECT p AS k, count(*) AS n FROM nodes WHERE p IS NOT NULL GROUP BY p),
    facts AS (SELECT x.*, coalesce(y.n, 0) AS kids FROM nodes x LEFT JOIN kids y USING (k)),
    sums AS (
        SELECT a.k, count(*) FILTER (kids = 0) AS leaves, sum((n - 1) * x.chars) AS saved
        FROM facts x JOIN prefixes a ON a.c = x.low AND a.d <= x.d GROUP BY a.k),
    ends AS (
        SELECT k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
        FROM (SELECT c, arg_max(k, d) AS k FROM prefixes GROUP BY c) GROUP BY k)
    SELECT x.low AS conv_id, x.d AS depth, u.low AS parent_conv_id, x.n AS n_convs, kids AS n_children, leaves AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM facts x JOIN sums s ON x.k = s.k LEFT JOIN nodes u ON x.p = u.k LEFT JOIN ends e ON x.k = e.k"""
