"""A whole table of searches against a catalog in one job.

No search is compared with every name. Each kind of pattern becomes an equality first and is
verified on the rows that meet there:

* exact: the folded name;
* prefix: the beginning of the path, for every pattern length that occurs;
* substring, wildcard, regex: three-character pieces of text. What every match must contain is a
  formula (of each part one of some texts, see ``functions.required``); of the part whose pieces the fewest
  names have, a match has one;
* fuzzy: pieces of the name (see ``fuzzy_join``);
* patterns without any required text (``*``, ``[0-9]+``): blocks of them meet blocks of distinct names;
* filters only: the best paths per extension and size cell.

Equal searches run once. Up to 64 searches, or patterns without required text, are conditions of a
single scan instead. A small table of searches is broadcast and the catalog is scanned without
a shuffle; only each partition's best k rows per search travel. A large one meets distinct names,
and the catalog is cut to the k best paths per name, extension and size cell before it is joined. Size
cells are dyadic: a file lies in one cell on each of 64 levels, a range of sizes is made of at most two
cells a level, so one scan answers any number of ranges and loses nothing.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from shelfmark.functions import regex
from shelfmark.functions.required import required_parts
from shelfmark.functions.scoring import score_name, score_size
from shelfmark.functions.text import for_value, wildcard_to_like, wildcard_to_regex
from shelfmark.operators.fuzzy_join import close_pairs
from shelfmark.operators.prefixes import beginnings, with_prefixes
from shelfmark.operators.rank import by_score
from shelfmark.operators.search import MAX_FUZZY_DISTANCE, MIN_FUZZY_DISTANCE
from shelfmark.plans.sizing import (
    BROADCAST_BYTES,
    broadcast_if_small,
    first_k_per,
    join_hot_keys,
    keep_keys_of,
    keep_known,
)
from shelfmark.plans.storage import reliable
from shelfmark.schema import CATALOG_COLUMNS

SETTINGS = [
    "type",
    "pattern",
    "case_sensitive",
    "extensions",
    "min_size",
    "max_size",
    "fuzzy_distance",
]
GRAM = 3
#: So many patterns are conditions in a plan; more are matched as a table.
LITERALS = 64
#: Names and patterns of one block.
NAMES_PER_BLOCK, PATTERNS_PER_BLOCK = 1_000, 1_000
#: Level of the cell that all files are in, whatever their size.
WHOLE = 64
ANY_EXTENSION = "*"


def _distinct_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(query_id, qkey)`` for the readable rows, and the distinct searches, prepared.

    Both are kept, because every later step starts from them.
    """
    usable = queries.filter(F.col("error").isNull()).withColumn(
        "extensions", F.array_sort(F.array_distinct("extensions"))
    )
    key = F.md5(F.to_json(F.struct(*SETTINGS)))
    keyed = reliable(usable.select("query_id", key.alias("qkey"), *SETTINGS))
    settings = [F.first(c).alias(c) for c in SETTINGS]
    return keyed.select("query_id", "qkey"), reliable(
        _prepared(keyed.groupBy("qkey").agg(*settings))
    )


def _regex_parts(patterns: pd.Series) -> pd.Series:
    return patterns.map(required_parts)


def _text_parts(pattern: Column, kind: Column) -> Column:
    """The parts of substrings and wildcards: each has a single text."""
    runs = F.when(kind == "substring", F.array(pattern)).when(
        kind == "wildcard", F.filter(F.split(pattern, r"[*?]+"), lambda t: t != "")
    )
    return F.transform(runs, lambda t: F.array(t))


def _gram_size(text: Column) -> Column:
    return F.least(F.lit(GRAM), F.char_length(text))


def _prepared(wanted: DataFrame) -> DataFrame:
    """Add what matching needs: whether to fold, the text to verify with, the required ``parts`` and
    whether they are folded, and the ``keys`` of searches that are equalities; a match has one of them."""
    folds = ~F.col("case_sensitive") & (F.col("type") != "regex")
    folded = F.when(F.col("folds"), F.lower("pattern")).otherwise(F.col("pattern"))
    needle = (
        F.when(F.col("type") == "wildcard", wildcard_to_like(folded))
        .when(F.col("type") == "regex", regex.to_java(F.col("pattern")))
        .otherwise(folded)
    )
    distance = F.greatest(
        F.lit(MIN_FUZZY_DISTANCE), F.least(F.lit(MAX_FUZZY_DISTANCE), "fuzzy_distance")
    )
    clamped = F.when(F.col("type") == "fuzzy", distance).otherwise(F.col("fuzzy_distance"))
    is_regex = F.col("type") == "regex"
    settled = wanted.withColumns({"folds": folds, "fuzzy_distance": clamped})
    settled = settled.withColumns(
        {
            "needle": needle,
            "folded_parts": F.col("folds") | (is_regex & F.col("pattern").rlike(r"^\(\?[msU]*i[imsU]*\)")),
        }
    )
    # Only regexes go through Python, which reads each of them once.
    regex_parts = F.pandas_udf(_regex_parts, T.ArrayType(T.ArrayType(T.StringType())))
    read = settled.filter(is_regex).withColumn("parts", regex_parts("pattern")).unionByName(
        settled.filter(~is_regex).withColumn("parts", _text_parts(folded, F.col("type")))
    )
    # Without counts, the part whose shortest text is longest.
    rated = F.transform(
        "parts",
        lambda p: F.struct(
            F.array_min(F.transform(p, _gram_size)), -F.size(p), F.array_min(F.transform(p, F.char_length)), p.alias("texts")
        ),
    )
    best = F.array_max(rated)["texts"]
    pieces = F.transform(best, lambda t: _gram_key(F.substring(t, F.lit(1), _gram_size(t)), F.col("folded_parts")))
    keys = (
        F.when(F.col("type") == "exact", F.array(F.xxhash64(F.lit("exact"), F.lower("pattern"))))
        .when(F.col("type") == "prefix", F.array(F.xxhash64(F.lit("path"), "pattern")))
        .otherwise(F.array_distinct(pieces))
    )
    return read.withColumn("keys", keys)


def _gram_key(piece: Column, folded: Column) -> Column:
    return F.xxhash64(F.when(folded, "folded").otherwise("plain"), piece)


def _verified(with_paths: bool) -> Column:
    """The match itself; keys are hashes and only bring candidates together."""
    text = F.when(F.col("folds"), F.lower("name")).otherwise(F.col("name"))
    matches = (
        F.when(F.col("type") == "exact", text == F.col("needle"))
        .when(F.col("type") == "substring", F.contains(text, F.col("needle")))
        .when(F.col("type") == "wildcard", F.like(text, F.col("needle")))
    )
    if with_paths:
        matches = matches.when(
            F.col("type") == "prefix", F.startswith(F.col("path"), F.col("pattern"))
        )
    return matches.otherwise(F.rlike(F.col("name"), F.col("needle")))


def _grams(text: str, size: int, folds: bool) -> str:
    """SQL array of the keys of a text's distinct pieces."""
    kind = "folded" if folds else "plain"
    places = (
        f"IF(char_length(t) >= {size}, sequence(1, char_length(t) - {size - 1}), "
        "CAST(array() AS ARRAY<INT>))"
    )
    return for_value(
        text, f"array_distinct(transform({places}, i -> xxhash64('{kind}', substring(t, i, {size}))))"
    )


def _with_rarest_keys(
    keyed_names: DataFrame, wanted: DataFrame, pieces: list
) -> tuple[DataFrame, DataFrame]:
    """The searches with the keys of the part that the fewest names have, and the counts of keys.

    Of each text of a part its rarest piece counts; a part counts as much as its texts together.
    """
    texts = wanted.select("qkey", "folded_parts", F.posexplode("parts").alias("part", "texts")).select(
        "qkey", "folded_parts", "part", F.posexplode("texts").alias("number", "text")
    )
    options = F.lit(None).cast("array<bigint>")
    for size, folds in pieces:
        same = (F.col("folded_parts") == folds) & (_gram_size(F.col("text")) == size)
        options = F.when(same, F.expr(_grams("text", size, folds))).otherwise(options)
    offered = reliable(texts.select("qkey", "part", "number", F.explode(options).alias("key")))
    # Only keys that some search could take are counted.
    distinct = offered.select("key").distinct()
    counted = keep_keys_of(keyed_names, distinct, "key").groupBy("key")
    counts = reliable(counted.agg(F.count(F.lit(1)).alias("rows")).join(distinct, "key", "left_semi"))
    known = offered.join(counts, "key", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rarest = (
        known.groupBy("qkey", "part", "number")
        .agg(F.min(F.struct("rows", "key")).alias("best"))
        .groupBy("qkey", "part")
        .agg(F.sum("best.rows").alias("rows"), F.array_sort(F.collect_set("best.key")).alias("keys"))
        .groupBy("qkey")
        .agg(F.min(F.struct("rows", F.size("keys").alias("size"), "keys")).alias("best"))
        .select("qkey", F.col("best.keys").alias("rarest"))
    )
    found = wanted.join(rarest, "qkey", "left")
    chosen = F.coalesce("rarest", "keys").alias("keys")
    return reliable(found.select(*[c for c in wanted.columns if c != "keys"], chosen)), counts


def _match_keyed(
    named: DataFrame, wanted: DataFrame, shapes: list, pick_rarest: bool
) -> DataFrame:
    """Searches that become equalities: exact, prefix and those with required text.

    A name brings all its keys, a search those of which a match has one at least. A match counts where
    the key is the smallest that both have, so it is found once. ``pick_rarest`` chooses the part of the
    required text whose pieces the fewest names have.
    """
    keys = []
    if any(s.type == "exact" for s in shapes):
        keys.append("array(xxhash64('exact', lower(name)))")
    if any(s.type == "prefix" for s in shapes):
        lengths = sorted({s.length for s in shapes if s.length is not None})
        keys.append(f"transform({beginnings('path', lengths)}, p -> xxhash64('path', p))")
    pieces = sorted({(size, s.folded_parts) for s in shapes for size in s.gram_sizes or ()})
    for size, folds in pieces:
        keys.append(_grams("lower(name)" if folds else "name", size, folds))
    all_keys = f"concat({', '.join(keys)})"

    counts = None
    if pick_rarest and pieces:
        keyed_names = named.selectExpr("*", f"explode({all_keys}) AS key")
        wanted, counts = _with_rarest_keys(keyed_names, wanted, pieces)
    keyed = wanted.withColumn("key", F.explode("keys"))
    known_keys = keep_known(all_keys, keyed)
    keyed_names = named.selectExpr("*", f"explode({known_keys}) AS key")
    if pick_rarest:
        keyed_names = keep_keys_of(keyed_names, keyed, "key")
    met = join_hot_keys(
        keyed_names, keyed, "key", known_small=not pick_rarest, counts=counts
    )
    # Worked out again for true matches only: keys would make every candidate row many times as long.
    shared = F.array_min(F.array_intersect(F.expr(all_keys), F.col("keys")))
    matches = _verified("path" in named.columns)
    first = F.when(F.size("keys") == 1, True).otherwise(F.col("key") == shared)
    return met.filter(F.when(matches, first).otherwise(F.lit(False)))


def _few(wanted: DataFrame) -> list | None:
    """The searches, if they are few enough to be conditions in a plan."""
    rows = wanted.select("qkey", "type", "pattern", "folds", "needle").limit(LITERALS + 1).collect()
    return rows if len(rows) <= LITERALS else None


def _match_literals(named: DataFrame, wanted: DataFrame, rows: list) -> DataFrame:
    """Few searches as conditions of one scan; their patterns are compiled once."""
    hits = []
    for row in rows:
        name = F.lower("name") if row.folds else F.col("name")
        if row.type == "regex":
            hit = name.rlike(row.needle)
        elif row.type == "prefix":
            hit = F.col("path").startswith(row.pattern)
        elif row.type == "exact":
            hit = name == row.needle
        elif row.type == "substring":
            hit = name.contains(row.needle)
        else:
            hit = name.like(row.needle)
        hits.append(F.when(hit, F.lit(row.qkey)))
    scan = named.withColumn("qkey", F.explode(F.array_compact(F.array(*hits))))
    return scan.join(F.broadcast(wanted), "qkey")


def _match_blocks(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of patterns against blocks of distinct names; no pattern gets into the driver or the plan.

    A block of names is one array, and a pattern goes through the whole of it, so it is compiled once
    per block. The hits are written, and met by their names again.
    """
    def blocks(rows: DataFrame, key: str, size: int, number: str, values: Column) -> tuple[DataFrame, int]:
        kept = reliable(rows)
        count = max(1, -(-kept.count() // size))
        block = F.pmod(F.xxhash64(key), F.lit(count)).alias(number)
        return kept.groupBy(block).agg(F.collect_list(values).alias(f"{number}s")), count

    folded = F.when(F.col("folds"), F.lower("pattern")).otherwise(F.col("pattern"))
    whole_name = F.concat(F.lit("(?s)"), wildcard_to_regex(folded))
    matcher = F.when(F.col("type") == "regex", F.col("needle")).otherwise(whole_name).alias("matcher")
    asked, count = blocks(
        wanted.select("qkey", "folds", matcher), "qkey", PATTERNS_PER_BLOCK, "pattern", F.struct("qkey", "folds", "matcher")
    )
    names, _ = blocks(
        named.select("name").distinct(), "name", NAMES_PER_BLOCK, "name", F.struct("name", F.lower("name").alias("lower"))
    )
    few = broadcast_if_small(asked)
    pairs = names.withColumn("pattern", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(
        asked if few is None else few, "pattern"
    )

    def hits_of(p: Column) -> Column:
        # Unlike ``rlike``, this function compiles a pattern again only when it changes.
        def hit(n: Column) -> Column:
            return F.regexp_instr(F.when(p["folds"], n["lower"]).otherwise(n["name"]), p["matcher"]) > 0

        return F.struct(p["qkey"], F.transform(F.filter("names", hit), lambda n: n["name"]).alias("names"))

    hits = pairs.select(F.explode(F.transform("patterns", hits_of)).alias("hit"))
    hits = reliable(hits.select("hit.qkey", F.explode("hit.names").alias("name")))
    met = join_hot_keys(hits, wanted, "qkey")
    return join_hot_keys(met, named, "name", known_small=False) if named.columns != ["name"] else met


def match_patterns(
    named: DataFrame, wanted: DataFrame, small: bool, broadcast_bytes: int
) -> DataFrame | None:
    """Rows of ``named`` joined with the searches whose pattern matches; ``None`` for none.

    ``named`` has a ``name``, and a ``path`` if there are prefix searches; ``small`` says that
    ``wanted`` may be broadcast.
    """
    out = named.columns + ["qkey"] + SETTINGS
    length = F.when(F.col("type") == "prefix", F.char_length("pattern")).alias("length")
    distance = F.when(F.col("type") == "fuzzy", F.col("fuzzy_distance")).alias("distance")
    sizes = F.array_sort(F.array_distinct(F.transform(F.flatten("parts"), _gram_size))).alias("gram_sizes")
    shapes = (
        wanted.select("type", "folds", "folded_parts", sizes, length, distance)
        .withColumn("keyed", F.col("type").isin("exact", "prefix") | (F.size("gram_sizes") > 0))
        .distinct()
        .collect()
    )
    found = None
    others = wanted.filter("type <> 'fuzzy'")
    few = _few(others) if small and any(s.type != "fuzzy" for s in shapes) else None
    keyed_shapes = [s for s in shapes if s.keyed]
    if few is not None:
        found = _match_literals(named, others, few).select(*out)
    else:
        if keyed_shapes:
            met = _match_keyed(named, wanted.filter("keys IS NOT NULL"), keyed_shapes, not small)
            found = met.select(*out)
        if any(not s.keyed and s.type != "fuzzy" for s in shapes):
            unkeyed = others.filter("keys IS NULL")
            rows = _few(unkeyed)
            met = _match_blocks(named, unkeyed) if rows is None else _match_literals(named, unkeyed, rows)
            found = _union(found, met.select(*out))
    for folds in sorted({s.folds for s in shapes if s.type == "fuzzy"}):
        fuzzy = wanted.filter((F.col("type") == "fuzzy") & (F.col("folds") == folds))
        pairs = close_pairs(
            named.withColumn("text", F.lower("name") if folds else F.col("name")),
            fuzzy.selectExpr("qkey", *SETTINGS, "needle AS text", "fuzzy_distance AS distance"),
            broadcast_bytes,
            sorted({s.distance for s in shapes if s.type == "fuzzy" and s.folds == folds}),
        )
        found = _union(found, pairs.select(*out))
    return found


def _passes_filters() -> Column:
    no_extension = F.size("extensions") == 0
    sized = F.col("min_size").isNotNull() | F.col("max_size").isNotNull()
    return (
        (no_extension | F.array_contains("extensions", F.col("extension")))
        & ((no_extension & ~sized) | ~F.col("is_dir"))
        & (F.col("size") >= F.coalesce("min_size", F.col("size")))
        & (F.col("size") <= F.coalesce("max_size", F.col("size")))
    )


def _scored(df: DataFrame) -> DataFrame:
    points = score_name(F.col("name"), F.col("pattern"), True, F.col("case_sensitive"))
    score = F.when(F.col("pattern") == "", 0).otherwise(points + score_size(F.col("size")))
    return df.withColumn("score", score.cast("int"))


def size_cells(low: str = "min_size", high: str = "max_size") -> str:
    """SQL array of the dyadic cells ``(level, cell)`` that a range of sizes is made of, both ends
    included; cell ``c`` of level ``l`` has the sizes from ``c * 2^l`` on. Without bounds it is the whole."""
    # On each level the range begins at the first whole cell and ends behind the last one; a cell at either
    # end that is not half of a larger one inside the range is taken.
    below = "IF(l = 0, 0L, shiftrightunsigned(-1L, 64 - l))"
    first = f"(shiftright(lo, l) + IF(lo & {below} <> 0, 1, 0))"
    last = f"(shiftright(hi, l) - IF((hi & {below}) = {below}, 0, 1))"
    cells = f"""flatten(transform(sequence(0, 63), l -> IF({first} <= {last}, filter(array(
        IF({first} & 1 = 1, struct(l AS level, {first} AS cell), NULL),
        IF({last} & 1 = 0, struct(l AS level, {last} AS cell), NULL)), c -> c IS NOT NULL),
        CAST(array() AS ARRAY<STRUCT<level: INT, cell: BIGINT>>))))"""
    bound = f"""flatten(transform(array(coalesce({low}, {-(1 << 63) + 1}L - 1L)), lo ->
        flatten(transform(array(coalesce({high}, {(1 << 63) - 1}L)), hi -> {cells}))))"""
    return f"IF({low} IS NULL AND {high} IS NULL, array(struct({WHOLE} AS level, 0L AS cell)), {bound})"


def _with_asked_cells(files: DataFrame, places: DataFrame) -> DataFrame:
    """Files with each ``place`` (level, cell) that some search asks for."""
    cells = places.distinct()
    levels = [r.level for r in cells.select("place.level").distinct().orderBy("level").collect()]
    in_cells = [
        F.struct(
            F.lit(level).alias("level"),
            (F.lit(0).cast("bigint") if level == WHOLE else F.shiftright("size", level)).alias("cell"),
        )
        for level in levels
    ]
    if not in_cells:
        in_cells = [F.struct(F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("cell"))]
    placed = files.withColumn("place", F.explode(F.array(*in_cells)))
    few = broadcast_if_small(cells)
    return placed.join(cells if few is None else few, "place", "left_semi")


def _filters_only(files: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Searches without a pattern: path order, so the first k paths per cell are enough."""
    groups = F.when(F.size("extensions") == 0, F.array(F.lit(ANY_EXTENSION))).otherwise(
        F.col("extensions")
    )
    asked = wanted.withColumn("group", F.explode(groups)).withColumn("place", F.explode(F.expr(size_cells())))
    celled = _with_asked_cells(files.filter(~F.col("is_dir")), asked.select("place"))
    per_extension = first_k_per(celled, ["extension", "place"], ["path"], k, "n", much_alike=True).drop("n")
    per_cell = first_k_per(per_extension, ["place"], ["path"], k, "n").drop("n")
    best = per_extension.withColumn("group", F.col("extension")).unionByName(
        per_cell.withColumn("group", F.lit(ANY_EXTENSION))
    )
    met = F.struct("group", "place")
    return join_hot_keys(
        asked.withColumn("met", met).drop("group", "place"),
        best.withColumn("met", met).drop("group", "place"),
        "met",
        known_small=False,
    ).drop("met")


def _best_per_cell(files: DataFrame, wanted: DataFrame, key: str, keys: list[str], k: int) -> DataFrame:
    """Searches, which have a ``key`` already, with the files of it that can be among their best k.

    ``keys`` are what scores and filters depend on besides sizes, so in a group and cell the order is
    by the size's points, then path.
    """
    asked = wanted.withColumn("place", F.explode(F.expr(size_cells())))
    celled = _with_asked_cells(files, asked.select("place"))
    order = [score_size(F.col("size")).desc(), "path"]
    best = first_k_per(celled, [*keys, "place"], order, k, "n").drop("n")
    met = F.struct(key, "place")
    return join_hot_keys(
        asked.withColumn("met", met).drop("place"),
        best.select(met.alias("met"), *[c for c in CATALOG_COLUMNS if c != key]),
        "met",
        known_small=False,
    ).drop("met")


def search_many(
    files: DataFrame, queries: DataFrame, k: int = 50, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """The best ``k`` rows for every search of a table read by ``parse_queries``.

    Returns ``query_id``, ``rank`` (from 1), ``score`` and the catalog columns; rows with an
    ``error`` are left out. Each search gives what ``search`` gives for it alone.
    """
    files = files.select(*CATALOG_COLUMNS)
    asked, wanted = _distinct_queries(queries)
    small = broadcast_if_small(wanted, broadcast_bytes) is not None
    with_text = wanted.filter(F.col("pattern") != "")
    by_name = with_text.filter(F.col("type") != "prefix")
    by_path = with_text.filter(F.col("type") == "prefix")
    without_text = wanted.filter(F.col("pattern") == "")
    out = ["qkey", *SETTINGS, *CATALOG_COLUMNS]

    if small:
        found = match_patterns(files, with_text, True, broadcast_bytes)
        if found is not None:
            found = found.select(*out).filter(_passes_filters())
    else:
        found = None
        names = reliable(files.select("name").distinct())
        pairs = match_patterns(names, by_name, False, broadcast_bytes)
        pairs = None if pairs is None else reliable(pairs)
        if pairs is not None:
            group = ["name", "extension", "is_dir"]
            part = _best_per_cell(files, pairs, "name", group, k)
            found = part.select(*out).filter(_passes_filters())
        if not by_path.isEmpty():
            asked_starts = by_path.select("pattern").distinct()
            few = broadcast_if_small(asked_starts, broadcast_bytes)
            # Beginnings that nobody asks for go before anything is shuffled or ranked.
            starts = with_prefixes(files, by_path, "pattern").join(
                asked_starts if few is None else few, "pattern", "left_semi"
            )
            points = {
                f"points_{case}": score_name(F.col("name"), F.col("pattern"), True, case)
                for case in (True, False)
            }
            group = ["pattern", "extension", "is_dir", *points]
            part = _best_per_cell(starts.withColumns(points), by_path, "pattern", group, k)
            found = _union(found, part.select(*out).filter(_passes_filters()))
    if not without_text.isEmpty():
        found = _union(found, _filters_only(files, without_text, k).select(*out))

    if found is None:
        found = files.withColumn("qkey", F.lit("")).join(wanted.limit(0), "qkey").select(*out)
    best = first_k_per(_scored(found), ["qkey"], by_score(), k, "rank")
    results = best.select("qkey", "rank", "score", *CATALOG_COLUMNS)
    return join_hot_keys(asked, results, "qkey", known_small=False).select(
        "query_id", "rank", "score", *CATALOG_COLUMNS
    )


def _union(left: DataFrame | None, right: DataFrame) -> DataFrame:
    return right if left is None else left.unionByName(right)
