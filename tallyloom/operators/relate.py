"""How tables relate: overlaps, join candidates, keys.

All candidate pairs of all tables are measured together: the candidate
columns are unpivoted to value digests and counted per value and column; then
each value lists the columns that hold it, at most all of them, and only the
candidate pairs in its list are counted. Values are never paired with each other.

Before that, one sketch per column tells which pairs can qualify at all; only
the columns of those are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import fixed_values as fixed
from tallyloom.functions.scalars import col, constant_rows, kind, kinds, name_similarity, row_digest, share
from tallyloom.operators.profile import per_column

Candidate = tuple[str, str, str, str]  # source table, target table, source column, target column

_NUMBER = ("integer", "decimal")

#: Values per column sketch (as a power of two).
LOG_VALUES = 12
#: What sketched numbers of values may be off by: over five standard deviations.
MARGIN = 0.1
#: A pair that qualifies is taken for one that cannot with a chance below e to the power of minus this.
SURE = 30


def _comparable(df: DataFrame, name: str) -> Column:
    """Text form in which equal values of one kind are equal: 1 and 1.0 agree, 1 and '1' do not."""
    value, k = col(name), kind(df.schema[name].dataType)
    if k == "decimal":
        whole = (value == F.floor(value)) & (F.abs(value) < 2 ** 53)
        text = F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("double").cast("string"))
    else:
        text = value.cast("string")
    return F.concat(F.lit("number:" if k in _NUMBER else f"{k}:"), text)


def column_sketches(tables: Mapping[str, DataFrame], ends: Iterable[tuple[str, str]]) -> DataFrame:
    """(table, column, rows, nulls, sketch, low, high) per named column, in one scan per table and without a shuffle of rows.

    ``sketch`` is a theta sketch of the values as they are compared, ``low`` and ``high`` are the bounds of numbers.
    """
    ends = set(ends)
    parts = []
    for table, df in tables.items():
        mine = [c for c in df.columns if (table, c) in ends]
        if mine:
            numbers = {c for c in mine if kind(df.schema[c].dataType) in _NUMBER}

            def bound(function, c, numbers=numbers):
                return function(col(c).cast("double") if c in numbers else F.lit(None).cast("double"))

            parts.append(per_column(df, mine, {
                "rows": lambda c: F.count(F.lit(1)), "nulls": lambda c: F.count_if(col(c).isNull()),
                "sketch": lambda c, df=df: F.theta_sketch_agg(F.when(col(c).isNotNull(), F.xxhash64(_comparable(df, c))), LOG_VALUES),
                "low": lambda c, bound=bound: bound(F.min, c), "high": lambda c, bound=bound: bound(F.max, c),
            }).withColumn("table", F.lit(table)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _cannot_qualify(least: float, inside: bool) -> Column:
    """Whether the sketches of columns ``x`` and ``y`` rule their pair out.

    ``inside``: all values of y have to be in x. A value of y among the smallest digests of both that x lacks
    proves the contrary. Otherwise a value in common is wanted, or ``least`` of the smaller side's values. Up to the
    size of the sketches these are exact; beyond, the sample has to make it all but impossible.
    """
    x, y = F.col("x.sketch"), F.col("y.sketch")
    if inside:
        outside = (F.col("y.low") < F.col("x.low")) | (F.col("y.high") > F.col("x.high"))
        return F.coalesce(outside, F.lit(False)) | (F.theta_sketch_estimate(F.theta_difference(y, x)) > 0)
    apart = F.coalesce((F.col("y.low") > F.col("x.high")) | (F.col("y.high") < F.col("x.low")), F.lit(False))
    in_x, in_y, both = (F.theta_sketch_estimate(s) for s in (x, y, F.theta_intersection(x, y)))
    small, large = F.least(in_x, in_y), F.greatest(in_x, in_y)
    whole = large < 2 ** LOG_VALUES
    if not least:
        return apart | (whole & (both == 0))
    wanted = small * (least * (1 - MARGIN))
    part = share(both, wanted)
    sampled = share(wanted * 2 ** LOG_VALUES, large * (1 + MARGIN))
    # The chance that a sample of Poisson's kind has only this part of its mean (Chernoff).
    doubt = sampled * (1 - part + F.when(part > 0, part * F.ln(part)).otherwise(0))
    return apart | (small == 0) | F.coalesce((part < 1) & (whole | (doubt > SURE)), F.lit(False))


def possible_candidates(
    tables: Mapping[str, DataFrame], candidates: Iterable[Candidate], least: float = 0.0, inside: bool = False,
) -> list[Candidate]:
    """The candidates that can qualify, by one sketch per column: any value in common, or ``least`` of the values of one side.

    With ``inside`` all values of the target column have to be in the source column. Columns of different kinds share
    nothing. Nothing that qualifies is left out, but for a chance of e to the power of minus ``SURE`` where columns of
    more values than a sketch holds share just ``least`` of them.
    """
    def comparable(end):
        k = kind(tables[end[0]].schema[end[1]].dataType)
        return "number" if k in _NUMBER else k

    candidates = [c for c in candidates if inside or comparable((c[0], c[2])) == comparable((c[1], c[3]))]
    if not candidates:
        return []
    sketches = column_sketches(tables, {e for s, t, a, b in candidates for e in ((s, a), (t, b))})
    pairs = constant_rows(sketches.sparkSession, [(i, *c) for i, c in enumerate(candidates)], "i int, s string, t string, a string, b string")
    met = (
        pairs.join(sketches.alias("x"), (F.col("s") == F.col("x.table")) & (F.col("a") == F.col("x.column")))
        .join(sketches.alias("y"), (F.col("t") == F.col("y.table")) & (F.col("b") == F.col("y.column"))))
    return [candidates[r["i"]] for r in met.where(~_cannot_qualify(least, inside)).select("i").orderBy("i").collect()]


def measure_candidates(tables: Mapping[str, DataFrame], candidates: Iterable[Candidate]) -> DataFrame:
    """One row per candidate pair with rows, distinct, common and included counts.

    ``*_rows`` count all rows of the table, ``*_values`` distinct non-null
    values, ``*_nulls`` NULLs, ``common`` values on both sides, ``source_rows_found`` the source
    rows whose value the target has.
    """
    candidates = list(candidates)
    ends = sorted({(t, c) for s, t2, a, b in candidates for t, c in ((s, a), (t2, b))})
    index = {end: i for i, end in enumerate(ends)}
    parts = []
    for table, df in tables.items():
        mine = [(i, c) for (t, c), i in index.items() if t == table]
        if not mine:
            continue
        cells = []
        for i, c in mine:
            h1, h2 = row_digest([_comparable(df, c)])
            known = col(c).isNotNull()
            cells.append(F.struct(
                F.lit(i).alias("end"), F.when(known, h1).alias("h1"), F.when(known, h2).alias("h2")))
        parts.append(df.select(F.inline(F.array(*cells))))
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    tally = values.groupBy("h1", "h2", "end").agg(F.count("*").alias("n"))
    known = F.col("h1").isNotNull()
    per_end = tally.groupBy("end").agg(
        F.sum("n").alias("rows"), F.count_if(known).alias("values"), F.sum(F.when(~known, F.col("n")).otherwise(0)).alias("nulls"))

    pairs = [(index[(s, a)], index[(t, b)]) for s, t, a, b in candidates]
    targets = [set() for _ in ends]
    for x, y in pairs:
        targets[x].add(y)
    # One literal per column, however many candidates it has.
    wanted = F.array(*[F.from_json(F.lit(str(sorted(ys))), "array<int>") for ys in targets])
    least = 1 if any(x == y for x, y in pairs) else 2
    # NULLs are left out inside the aggregate: a filter would be pushed below the tally and part its two readers.
    per_value = tally.groupBy("h1", "h2").agg(F.collect_list(F.when(known, F.struct("end", "n"))).alias("ends")).where(F.size("ends") >= least)
    own = per_value.select(F.explode("ends").alias("own"), F.col("ends.end").alias("all"))
    met = own.select(F.col("own.end").alias("x"), F.col("own.n").alias("n"), F.explode(F.array_intersect("all", wanted[F.col("own.end")])).alias("y"))
    shared = met.groupBy("x", "y").agg(F.count("*").alias("common"), F.sum("n").alias("source_rows_found"))

    named = values.sparkSession.createDataFrame(
        [(*c, *xy) for c, xy in zip(candidates, pairs, strict=True)],
        "source_table string, target_table string, source_column string, target_column string, x int, y int")
    result = named.join(shared, ["x", "y"], "left")
    for side, at in (("source", "x"), ("target", "y")):
        result = result.join(per_end.select(F.col("end").alias(at), *[F.col(c).alias(f"{side}_{c}") for c in ("rows", "values", "nulls")]), at, "left")
    figures = [*[f"{side}_{c}" for side in ("source", "target") for c in ("rows", "values", "nulls")], "common", "source_rows_found"]
    return result.select("source_table", "target_table", "source_column", "target_column", *[F.coalesce(c, F.lit(0)).alias(c) for c in figures])


_NONE = (
    "source_table string, target_table string, source_column string, target_column string, "
    "relationship_type string, confidence double"
)


def _empty(tables: Mapping[str, DataFrame], schema: str = _NONE) -> DataFrame:
    return constant_rows(next(iter(tables.values())).sparkSession, [], schema)


def _relationship_type(limit: float) -> Column:
    source = share(F.col("source_values"), F.col("source_rows")) > limit
    target = share(F.col("target_values"), F.col("target_rows")) > limit
    return (
        F.when(source & target, "one-to-one").when(source, "one-to-many")
        .when(target, "many-to-one").otherwise("many-to-many")
    )


def _with_relationships(measured: DataFrame) -> DataFrame:
    source_overlap = share(F.col("common"), F.col("source_values"))
    target_overlap = share(F.col("common"), F.col("target_values"))
    unique = share(F.col("source_values"), F.col("source_rows")) * share(F.col("target_values"), F.col("target_rows"))
    return (
        measured.where("source_values > 0 and target_values > 0")
        .where((source_overlap >= fixed.MIN_OVERLAP) | (target_overlap >= fixed.MIN_OVERLAP))
        .withColumns({
            "source_overlap": F.round(source_overlap, 6), "target_overlap": F.round(target_overlap, 6),
            "relationship_type": _relationship_type(fixed.UNIQUE_RATIO),
            "confidence": F.round(
                F.least(source_overlap, target_overlap) * fixed.OVERLAP_WEIGHT + unique * fixed.UNIQUE_WEIGHT, 6),
        })
    )


def column_relationship(a: DataFrame, b: DataFrame, column_a: str, column_b: str,
                        name_a: str = "A", name_b: str = "B") -> DataFrame:
    """Overlap both ways, relationship type and confidence; no row without real overlap."""
    tables = {name_a: a, name_b: b}
    return _with_relationships(measure_candidates(tables, [(name_a, name_b, column_a, column_b)])).select(
        "source_table", "target_table", "source_column", "target_column",
        "source_overlap", "target_overlap", "relationship_type", "confidence")


def join_candidates(tables: Mapping[str, DataFrame]) -> list[Candidate]:
    """Same-named columns, and key-like columns of the same type, of every table pair."""
    found = []
    for s, t in combinations(tables, 2):
        a, b = tables[s], tables[t]
        pairs = [(c, c) for c in a.columns if c in b.columns]
        keyed_a, keyed_b = ([c for c in d.columns if any(w in c.lower() for w in fixed.JOIN_WORDS)] for d in (a, b))
        kind_a, kind_b = kinds(a), kinds(b)
        for x in keyed_a:
            for y in keyed_b:
                if (x, y) not in pairs and kind_a[x] == kind_b[y]:
                    pairs.append((x, y))
        found += [(s, t, x, y) for x, y in pairs]
    return found


def detect_relationships(tables: Mapping[str, DataFrame]) -> DataFrame:
    candidates = possible_candidates(tables, join_candidates(tables), fixed.MIN_OVERLAP)
    if not candidates:
        return _empty(tables)
    return _with_relationships(measure_candidates(tables, candidates)).select(
        "source_table", "target_table", "source_column", "target_column", "relationship_type", "confidence")


def obvious_candidates(a: DataFrame, b: DataFrame) -> list[tuple[str, str]]:
    """Equal names first; with fewer than two of them also similar key-like names."""
    names_b = {}
    for c in b.columns:
        names_b.setdefault(c.lower().strip(), c)
    pairs, seen = [], set()
    for c in a.columns:
        key = c.lower().strip()
        if key in names_b and key not in seen:
            seen.add(key)
            pairs.append((c, names_b[key]))
    if len(pairs) < 2:
        keyed_a, keyed_b = (
            [c for c in d.columns if any(w in c.lower() for w in fixed.OBVIOUS_JOIN_WORDS)] for d in (a, b))
        pairs += [
            (x, y) for x in keyed_a for y in keyed_b
            if x != y and name_similarity(x, y) > fixed.NAME_SIMILARITY
        ]
    return pairs


def key_relationships(tables: Mapping[str, DataFrame], max_pairs: int | None = None, columns_per_pair: int | None = None) -> DataFrame:
    """Only confident relationships of the obvious candidates of all table pairs, or of as many as named."""
    candidates = possible_candidates(tables, [
        (s, t, x, y)
        for s, t in list(combinations(tables, 2))[:max_pairs]
        for x, y in obvious_candidates(tables[s], tables[t])[:columns_per_pair]
    ], fixed.MIN_OVERLAP)
    if not candidates:
        return _empty(tables)
    return _with_relationships(measure_candidates(tables, candidates)).where(
        F.col("confidence") > fixed.KEY_CONFIDENCE
    ).select("source_table", "target_table", "source_column", "target_column", "relationship_type", "confidence")


def shared_column_relationships(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Same-named columns that look like keys by name or by inclusion over one half."""
    candidates = [
        (s, t, c, c)
        for s, t in combinations(tables, 2) for c in tables[s].columns
        if c in tables[t].columns and c.lower() not in fixed.GENERIC_COLUMN_NAMES
    ]
    by_name = [c for c in candidates if c[2].lower().endswith("_id")]
    candidates = by_name + possible_candidates(tables, [c for c in candidates if c not in by_name])
    if not candidates:
        return _empty(tables)
    included = share(F.col("source_rows_found"), F.col("source_rows")) > 0.5
    return measure_candidates(tables, candidates).where(
        F.lower("source_column").endswith("_id") | included
    ).select(
        "source_table", "target_table", "source_column", "target_column",
        _relationship_type(fixed.SHARED_UNIQUE_RATIO).alias("relationship_type"), F.lit(0.7).alias("confidence"))


def id_column_relationships(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``id`` / ``*_id`` columns with any common value in a matching column of another table."""
    def is_id(name):
        return name.lower() == "id" or name.lower().endswith("_id")

    candidates = [
        (s, t, x, y)
        for s in tables for t in tables if s != t
        for x in tables[s].columns if is_id(x)
        for y in tables[t].columns
        if x == y or (y.lower().endswith("_id") and x.replace("_id", "") in y.lower())
    ]
    candidates = possible_candidates(tables, candidates)
    if not candidates:
        return _empty(tables)
    return measure_candidates(tables, candidates).where("common > 0").select(
        "source_table", "target_table", "source_column", "target_column",
        F.lit("one-to-many").alias("relationship_type"), F.lit(0.8).alias("confidence"))


def foreign_keys_within(df: DataFrame) -> DataFrame:
    """Columns of one table whose values all occur in a near-unique column of it.

    One scan of sketches finds the near-unique columns and the columns that may lie in them, so that only those are
    counted. A column of NULLs alone lies in every key.
    """
    tables = {"t": df}
    sketches = column_sketches(tables, {("t", c) for c in df.columns})
    near = (
        (F.theta_sketch_estimate("sketch") > fixed.UNIQUE_RATIO * (1 - MARGIN) * F.col("rows"))
        & (share(F.col("nulls"), F.col("rows")) < 0.01))
    keys = sketches.where(near).alias("x")
    met = keys.join(sketches.alias("y"), (F.col("x.table") == F.col("y.table")) & (F.col("x.column") != F.col("y.column")))
    found = met.where(~_cannot_qualify(0, inside=True)).select(F.col("x.column").alias("key"), F.col("y.column").alias("other"))
    candidates = [("t", "t", *r) for r in sorted(found.collect())]  # pairs of columns
    if not candidates:
        return _empty(tables, "primary_key string, foreign_key string, confidence double")
    measured = measure_candidates(tables, candidates)
    return measured.where(
        (share(F.col("source_values"), F.col("source_rows")) > fixed.UNIQUE_RATIO)
        & (share(F.col("source_nulls"), F.col("source_rows")) < 0.01)
        & (F.col("common") == F.col("target_values"))
    ).select(
        F.col("source_column").alias("primary_key"), F.col("target_column").alias("foreign_key"),
        F.round(share(F.col("target_values"), F.col("source_values")), 6).alias("confidence"))
