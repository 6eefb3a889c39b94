"""Matching of headers with known schemas (as joins) and with fields (as metadata)."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.naming import plain, snake
from tidewell.operators.upsert import numbered
from tidewell.workspace import Workspace

#: Fixed values.
SEMANTIC_GROUPS = (
    ("id", "code", "number", "ref", "reference"),
    ("name", "title", "label", "description"),
    ("date", "time", "datetime", "created", "modified"),
    ("price", "cost", "amount", "rate", "value", "total"),
    ("email", "mail", "email_id"),
    ("phone", "mobile", "contact", "tel"),
    ("address", "location", "addr"),
    ("quantity", "qty", "count", "num"),
    ("status", "state", "condition"),
    ("type", "category", "class", "kind"),
)
#: Fixed values.
SYNONYMS = (
    ("name", "title", "label", "display_name"),
    ("description", "desc", "details", "info", "notes"),
    ("price", "cost", "amount", "value", "rate"),
    ("type", "category", "kind", "class", "group"),
    ("id", "identifier", "key", "code", "uid"),
)
PRIMARY = ("id", "customer_id", "supplier_id", "email", "name", "code", "reference", "product_id", "product_name")
WEIGHTS = {"jaccard": 0.3, "coverage": 0.5, "exact": 0.2}
SIMILAR_FIELD, SIMILAR_TYPE, SEMANTIC = 0.6, 0.3, 0.8


def jaccard(a: Column, b: Column) -> Column:
    """Of two array columns; 0 if both are empty."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def header_sets(df: DataFrame, by: str, header: str) -> DataFrame:
    """(by, headers): the different headers of each schema; schemas are metadata, so the arrays are short."""
    return df.groupBy(by).agg(F.array_sort(F.collect_set(F.lower(F.trim(header)))).alias("headers"))


def schema_scores(headers: DataFrame, fields: DataFrame) -> DataFrame:
    """Scores of every (source, header) set against every (target, field) set, by a join on the names.

    Of common names, of all, of the source's and exact ones: 0.3 Jaccard + 0.5 coverage + 0.2 exact.
    Exact names are equal before hyphens and blanks became underscores.
    """
    one = headers.select("source", F.translate(F.lower(F.trim("header")), " -", "__").alias("n"), F.lower(F.trim("header")).alias("raw")).distinct()
    two = fields.select("target", F.translate(F.lower(F.trim("field")), " -", "__").alias("n"), F.lower(F.trim("field")).alias("raw_field")).distinct()
    sizes = one.groupBy("source").agg(F.count_distinct("n").alias("n_source"))
    target_sizes = two.groupBy("target").agg(F.count_distinct("n").alias("n_target"))
    common = one.join(two, "n").groupBy("source", "target").agg(F.count_distinct("n").alias("n_both"), F.count_distinct(F.when(F.col("raw") == F.col("raw_field"), F.col("n"))).alias("n_exact"))
    joined = common.join(sizes, "source").join(target_sizes, "target")
    j = F.col("n_both") / (F.col("n_source") + F.col("n_target") - F.col("n_both"))
    coverage, exact = F.col("n_both") / F.col("n_source"), F.col("n_exact") / F.col("n_source")
    return joined.select("source", "target", "n_both", F.round(WEIGHTS["jaccard"] * j + WEIGHTS["coverage"] * coverage + WEIGHTS["exact"] * exact, 6).alias("score"))


def best_schema(scores: DataFrame, threshold: float) -> DataFrame:
    """The target with the best score for each source, if it reaches the threshold; equals go to the first name."""
    best = scores.groupBy("source").agg(F.min_by(F.struct("target", "score"), F.struct(-F.col("score"), "target")).alias("b"))
    return best.select("source", "b.target", "b.score").filter(F.col("score") >= threshold)


def differences(a: Column, b: Column) -> tuple[Column, Column]:
    """(what only the first array has, what only the second has)"""
    return F.array_except(a, b), F.array_except(b, a)


def all_types(custom: DataFrame, standard: DataFrame) -> DataFrame:
    """The targets of both catalogs (target); ``custom`` tells where each comes from."""
    return custom.select("target", F.lit(True).alias("custom")).unionByName(standard.select("target", F.lit(False).alias("custom")))


def known_patterns(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files (file, schema_fingerprint) with the target of the registry entry of their schema, null where there is none.

    The registry has one entry for each schema; it is left to the size limit of broadcasts how it is joined.
    """
    return files.join(registry.select("schema_fingerprint", "target"), "schema_fingerprint", "left")


def threshold(setting: float | None) -> float:
    """A percentage as a share between 0.5 and 0.95; 0.8 if there is none."""
    return 0.8 if setting is None else max(0.5, min(setting / 100, 0.95))


def similar_types(sets: DataFrame, least: float = SIMILAR_TYPE, most: int = 10) -> DataFrame:
    """(a, b, similarity, matching) of pairs of schemas (by, headers); the few best."""
    a, b = (sets.select(F.col("by").alias(x), F.col("headers").alias(f"h_{x}")) for x in "ab")
    one, two = (s.select(x, f"h_{x}", F.explode(f"h_{x}").alias("h")) for s, x in ((a, "a"), (b, "b")))
    pairs = one.join(two, "h").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("matching"), F.first(jaccard(F.col("h_a"), F.col("h_b"))).alias("similarity"))
    return pairs.filter(F.col("similarity") > least).orderBy(F.desc("similarity"), "a", "b").limit(most)


#: Sets of up to so many items meet with all of them; rows of an item that meet in one cell; sets that share a rare item at most; members of a cell.
SMALL_SET, CELL, RARE, MEMBERS = 64, 2048, 16, 512


def similar_sets(items: DataFrame, by: str, item: str, percent: int = 80) -> DataFrame:
    """(a, b, matching, similarity) of all pairs of sets (rows of ``by`` and ``item``; a < b) with a Jaccard similarity of ``percent`` or more.

    Equal sets are compared as one.  Few pairs share an item that ``RARE`` sets or fewer have: these are counted one by one.  What any other
    pair has in common follows from the common items and the sizes, so sets with equal ones are a group, and groups are compared.  Only at the end
    are groups and equal sets told apart, cell by cell, and pairs that were found are not shuffled: work beyond that grows with the sets.

    Defined cases: null items and rows without a set are left out; repeated rows count once; other columns aren't looked at.
    """
    work = Workspace(items.sparkSession, "similar-sets")
    # Few rows may make many pairs, so how many tasks there are doesn't depend on their bytes.
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = items.select(F.col(f"`{by}`").alias("by"), F.col(f"`{item}`").alias("item")).dropna().groupBy("by").agg(F.array_sort(F.collect_set("item")).alias("items"))
    equal = Window.partitionBy("items")
    sets = work.write(sets.withColumns({"class": F.min("by").over(equal), "m": F.count("*").over(equal)}), "sets")
    each = sets.filter("by = class").select("by", F.explode("items").alias("item"))
    ranks = work.write(numbered(each.groupBy("item").agg(F.count("*").alias("often")), [], ["often", "item"], "rank"), "ranks")
    ordered = each.join(ranks, "item").groupBy("by").agg(F.array_sort(F.collect_list(F.struct("rank", "often"))).alias("items"))
    rare, common = (F.transform(F.filter("items", test), lambda x: x["rank"]) for test in (lambda x: x["often"] <= RARE, lambda x: x["often"] > RARE))
    ordered = work.write(ordered.select("by", F.size("items").alias("n"), rare.alias("rare"), common.alias("ranks")), "ordered")
    groups = work.write(ordered.groupBy("ranks", "n").agg(F.min("by").alias("group"), F.count("*").alias("k")), "groups")
    classes = work.write(ordered.join(groups, ["ranks", "n"]).select("by", "n", "group", "rare", "ranks"), "classes")
    alike = work.write(_alike_groups(groups, percent, tasks), "candidates")

    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    similarity = F.round(F.col("matching") / (F.col("n_a") + F.col("n_b") - F.col("matching")), 6).alias("similarity")
    result = [F.col("a"), F.col("b"), F.col("matching").cast("bigint").alias("matching"), similarity]
    rares = [classes.select(F.explode("rare").alias("rank"), *[F.col(c).alias(f"{c}_{x}") for c in ("by", "n", "group")]) for x in "ab"]
    shared = rares[0].join(rares[1], "rank").filter((F.col("by_a") < F.col("by_b")) & sizes).groupBy("by_a", "by_b", "n_a", "n_b", "group_a", "group_b").agg(F.count("*").alias("rare"))
    shared = work.write(shared, "shared")
    sides = [classes.select(F.col("by").alias(f"by_{x}"), F.col("ranks").alias(f"ranks_{x}")) for x in "ab"]
    judged = shared.join(sides[0], "by_a").join(sides[1], "by_b").withColumn("matching", F.col("rare") + F.size(F.array_intersect("ranks_a", "ranks_b")))
    judged = judged.filter((100 + percent) * F.col("matching") >= percent * (F.col("n_a") + F.col("n_b"))).select(F.col("by_a").alias("a"), F.col("by_b").alias("b"), "n_a", "n_b", "matching")
    copies = sets.filter("m > 1 and by = class").select(F.col("class").alias("a"), F.col("class").alias("b"), *[F.size("items").alias(c) for c in ("n_a", "n_b", "matching")])
    single = _expanded(judged.unionByName(copies).select(*result), sets.select(F.col("class").alias("unit"), "by"), work, "class", tasks)

    # Pairs that were counted by themselves are left out of their groups' pairs.
    known = shared.select("by_a", "by_b", F.least("group_a", "group_b").alias("a"), F.greatest("group_a", "group_b").alias("b")).join(alike, ["a", "b"], "left_semi")
    known = known.select(F.col("by_a").alias("class"), F.col("by_b").alias("other")).unionByName(known.select(F.col("by_b").alias("class"), F.col("by_a").alias("other")))
    known = known.groupBy("class").agg(F.collect_list("other").alias("known"))
    members = sets.select("by", "class").join(classes.select(F.col("by").alias("class"), F.col("group").alias("unit")), "class").join(known, "class", "left")
    return single.unionByName(_expanded(alike.select(*result), members, work, "group", tasks))


def _alike_groups(groups: DataFrame, percent: int, tasks: int) -> DataFrame:
    """(a, b, n_a, n_b, matching) of groups (group, n, ranks, k) whose sets are similar by their common items alone; a group of several sets with itself too.

    Similar groups share one of the first items of each that leave fewer than the least overlap, so only those, the rarest, are joined, and the
    places of a shared item bound what the groups can have in common.  Groups of few items bring all to the join, where a pair counts at its
    first shared item: pairs that aren't similar are never shuffled.  Pairs with a larger group are counted afterwards.
    """
    needed = lambda n: (100 + percent) * n >= percent * (F.col("n_a") + F.col("n_b"))
    often = groups.select(F.explode("ranks").alias("rank")).groupBy("rank").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells"))
    held = F.when(F.size("ranks") <= SMALL_SET, F.col("ranks")).alias("ranks")
    bits = F.expr("aggregate(ranks, 0L, (x, r) -> x | shiftleft(1L, cast(r % 64 as int)))").alias("bits")
    first = F.expr(f"slice(ranks, 1, greatest(0, cast(size(ranks) - ceil({percent} * n / 100) + 1 as int)))")
    prefixes = groups.select("group", "n", F.size("ranks").alias("c"), bits, held, F.posexplode(first).alias("at", "rank")).join(often, "rank")
    # The rows of a common item are dealt to cells on one side and stand in each on the other, so they take many tasks.
    one = prefixes.withColumn("cell", F.pmod(F.xxhash64("group"), F.col("cells")).cast("int"))
    two = prefixes.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    one, two = (x.select("rank", "cell", *[F.col(c).alias(f"{c}_{s}") for c in ("group", "n", "c", "bits", "ranks", "at")]).repartition(tasks, "rank", "cell") for x, s in ((one, "a"), (two, "b")))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # At a shared item that is the first of both, no more than what follows it in either can be common.
    bound = 1 + F.least(F.col("c_a") - F.col("at_a") - 1, F.col("c_b") - F.col("at_b") - 1)
    # Bits that differ stand for items that only one group has.
    most = (F.col("c_a") + F.col("c_b") - F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b")))) / 2
    met = one.join(two, ["rank", "cell"]).filter((F.col("group_a") < F.col("group_b")) & sizes & needed(bound) & needed(most))
    names = [F.col("group_a").alias("a"), F.col("group_b").alias("b"), "n_a", "n_b"]
    both = F.array_intersect("ranks_a", "ranks_b")  # in order
    small = met.filter(F.greatest("c_a", "c_b") <= SMALL_SET).filter(needed(F.size(both)) & (both[0] == F.col("rank"))).select(*names, F.size(both).alias("matching"))
    sides = [groups.select(F.col("group").alias(x), F.col("ranks").alias(f"all_{x}")) for x in "ab"]
    large = met.filter(F.greatest("c_a", "c_b") > SMALL_SET).select(*names).distinct().join(sides[0], "a").join(sides[1], "b")
    large = large.withColumn("matching", F.size(F.array_intersect("all_a", "all_b"))).filter(needed(F.col("matching"))).select(*small.columns)
    within = groups.filter("k > 1 and size(ranks) > 0").select(F.col("group").alias("a"), F.col("group").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"), F.size("ranks").alias("matching"))
    return small.unionByName(large).unionByName(within.filter(needed(F.col("matching"))))


def _expanded(pairs: DataFrame, members: DataFrame, work: Workspace, name: str, tasks: int) -> DataFrame:
    """Pairs (a, b, and more) of units as pairs of their members (unit, by), a < b.

    With ``class`` and ``known``, members of one class and those whose class the other knows make no pair.  Members meet cell by cell, and a
    row for two cells is all that is shuffled.
    """
    extra = [c for c in ("class", "known") if c in members.columns]
    size = members.groupBy("unit").agg(F.ceil(F.count("*") / MEMBERS).alias("cells"))
    dealt = members.join(size, "unit").withColumn("cell", F.pmod(F.xxhash64("by"), F.col("cells")).cast("int"))
    cells = work.write(dealt.groupBy("unit", "cell").agg(F.collect_list(F.struct("by", *extra)).alias("held")), f"{name}-cells")
    sides = [cells.select(F.col("unit").alias(x), F.col("cell").alias(f"cell_{x}"), F.col("held").alias(f"held_{x}")) for x in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b").filter("a != b or cell_a <= cell_b").repartition(tasks, "a", "b", "cell_a", "cell_b")
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    met = met.withColumn("same", F.expr("a = b and cell_a = cell_b")).select("same", *rest, "held_b", F.explode("held_a").alias("x")).select("same", *rest, "x", F.explode("held_b").alias("y"))
    met = met.filter("not same or x.by < y.by")
    if extra:
        met = met.filter("x.class != y.class and (x.known is null or not array_contains(x.known, y.class))")
    return met.select(F.least("x.by", "y.by").alias("a"), F.greatest("x.by", "y.by").alias("b"), *rest)


def closest_values(typed: DataFrame, column: str, known: DataFrame, value: str, most: int = 2, q: int = 2) -> DataFrame:
    """(typed, value, distance): for each different text of ``column`` the known value with the least edit distance, up to ``most``; the least of equals.

    Texts within ``most`` edits differ in at most ``most * q`` of their padded q-grams.  With each text's q-grams (repeats numbered) in one
    order for all, rarest first, they thus share one of the first ``most * q + 1``; only those are joined.  Texts with no more
    q-grams than that are joined by nearby lengths too, since they may share none.

    Defined cases: null texts find nothing and are not found; an empty text is one of length 0; repeated rows count once.
    """
    work = Workspace(typed.sparkSession, "closest")
    one = typed.select(F.col(f"`{column}`").cast("string").alias("text"), F.lit(True).alias("asked")).dropna().distinct()
    two = known.select(F.col(f"`{value}`").cast("string").alias("text"), F.lit(False).alias("asked")).dropna().distinct()
    pad = "\x01" * (q - 1)
    padded = F.concat(F.lit(pad), "text", F.lit(pad))
    grams = F.transform(F.sequence(F.lit(1), F.length("text") + (q - 1)), lambda i: F.substr(padded, i, F.lit(q)))
    counted = one.unionByName(two).withColumn("grams", F.when(F.length("text") > 0, grams).otherwise(F.array().cast("array<string>")))
    # A gram's n-th occurrence in a text is an item of its own.
    items = work.write(counted.select("asked", "text", F.explode("grams").alias("g")).groupBy("asked", "text", "g").agg(F.count("*").cast("int").alias("c")).select("asked", "text", F.explode(F.transform(F.sequence(F.lit(1), "c"), lambda i: F.concat("g", i.cast("string")))).alias("item")), "items")
    often = items.groupBy(F.col("item").alias("i")).agg(F.count("*").alias("often"))
    ordered = items.join(often, F.col("item") == F.col("i")).groupBy("asked", "text").agg(F.slice(F.array_sort(F.collect_list(F.struct("often", "item"))), 1, most * q + 1).alias("first"))
    rare = ordered.select("asked", "text", F.explode("first.item").alias("item"))
    short = counted.filter(F.length("text") + (q - 1) <= most * q).select("asked", "text")
    # Short texts stand at their own length and those that edits can reach.
    asked_at = short.filter("asked").select("text", F.explode(F.sequence(F.greatest(F.lit(0), F.length("text") - most), F.length("text") + most)).alias("item"))
    known_at = counted.filter("not asked").filter(F.length("text") + (q - 1) <= most * (q + 1)).select("text", F.length("text").alias("item"))
    pairs = _met(rare.filter("asked"), rare.filter("not asked"))
    found = pairs.unionByName(_met(asked_at, known_at)).filter(F.abs(F.length("typed") - F.length("value")) <= most).distinct()
    close = found.withColumn("distance", F.levenshtein("typed", "value")).filter(F.col("distance") <= most)
    return close.groupBy("typed").agg(F.min(F.struct("distance", "value")).alias("b")).select("typed", "b.value", "b.distance")


def _met(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(typed, value) of texts that share an item."""
    return asked.select(F.col("text").alias("typed"), "item").join(known.select(F.col("text").alias("value"), "item"), "item").select("typed", "value")


# ---- fields, as metadata


def semantic_similarity(a: str, b: str) -> float:
    return SEMANTIC if any(any(w in a for w in g) and any(w in b for w in g) for g in SEMANTIC_GROUPS) else 0.0


def field_similarity(a: str, b: str) -> float:
    """The best of: sequence ratio, share of a contained name, Jaccard of the words, and the semantic group."""
    if a == b:
        return 1.0
    held = min(len(a), len(b)) / max(len(a), len(b), 1) if a in b or b in a else 0.0
    x, y = set(a.split("_")), set(b.split("_"))
    return max(difflib.SequenceMatcher(None, a, b).ratio(), held, len(x & y) / len(x | y), semantic_similarity(a, b))


def map_headers(headers: list[str], fields: list[str]) -> dict[str, str]:
    """Header to field: cleaned name, then the most similar field (the first of equals, above 0.6); others are left out."""
    clean = {snake(f): f for f in reversed(fields)}
    out = {}
    for h in headers:
        x = snake(h)
        if x in clean:
            out[h] = clean[x]
            continue
        scored = [(field_similarity(x, snake(f)), f) for f in fields]
        best = max((s for s, _ in scored), default=0.0)
        if best > SIMILAR_FIELD:
            out[h] = next(f for s, f in scored if s == best)
    return out


def primary_column(headers: list[str]) -> str | None:
    """The first header that contains a word for an identifier."""
    return next((h for h in headers if any(w in h.lower() for w in PRIMARY)), None)


#: A small default of (pattern, field) rules, tried in order on the whole name; ``{table}`` stands for the target's name.
RULES = (("{table}_?(id|name)", r"{table}_\1"), ("id|title", "name"), ("price|cost", "price"), ("state|status", "status"))


def named_rules(target: str, rules: tuple[tuple[str, str], ...] = RULES) -> list[tuple[str, str]]:
    """The rules for one target."""
    table = snake(target)
    return [(pattern.replace("{table}", table), field.replace("{table}", table)) for pattern, field in rules]


def fields_alike(a: str, b: str) -> bool:
    """Equal without an ending, or in one group of synonyms."""
    a, b = (re.sub(r"_(id|name|type|code)$", "", x) for x in (a, b))
    return a == b or any(a in g and b in g for g in SYNONYMS)


def layered_mapping(headers: list[str], target: str, fields: list[str], universal: dict[str, str] | None = None, custom: dict[str, str] | None = None, named: tuple[tuple[str, str], ...] = RULES) -> dict[str, str | None]:
    """Custom rules over named ones (patterns) over universal ones; then a similar mapped name; then a field of the target."""
    rules: dict[str, str] = dict(universal or {})
    for h in headers:
        x = plain(h, dots=True)
        for pattern, field in named_rules(target, named):
            if m := re.fullmatch(pattern, x):
                rules[x] = m.expand(field)
                break
    rules |= custom or {}
    out: dict[str, str | None] = {}
    for h in headers:
        x = plain(h, dots=True)
        found = rules.get(x) or next((v for k, v in rules.items() if x in k or k in x or fields_alike(x, k)), None)
        out[h] = found or target_field(x, fields)
    return out


def target_field(x: str, fields: list[str]) -> str | None:
    """A field that contains the name or is contained, one for e-mail or phone, else a close one."""
    for f in fields:
        if x in f.lower() or f.lower() in x:
            return f
    for word in ("email", "phone"):
        if word in x and (found := next((f for f in fields if word in f.lower()), None)):
            return found
    return next(iter(difflib.get_close_matches(x, fields, 1, 0.6)), None)


def domain_mapping(target: str, table: dict[str, dict[str, str]]) -> dict[str, str]:
    """The header-to-field table of the first domain whose name stands in the target's, as ``universal`` rules."""
    low = target.lower()
    return next((dict(rules) for domain, rules in table.items() if domain.lower() in low), {})


def missing_fields(mapping: dict[str, str | None], kinds: dict[str, str]) -> list[tuple[str, str]]:
    """(field, SQL type) of headers without a field."""
    from tidewell.functions.content import SPARK_TYPES

    return [(plain(h, dots=True), SPARK_TYPES.get(kinds.get(h, "Data"), "string")) for h, f in mapping.items() if f is None]


def add_columns_statement(table: str, fields: list[tuple[str, str]]) -> str:
    return f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{n}` {t.upper()}' for n, t in fields)})"


def success_rate(mapping: dict[str, str | None]) -> float:
    return 100.0 * sum(f is not None for f in mapping.values()) / len(mapping) if mapping else 0.0


def keyword_scores(headers: list[str], patterns: dict[str, dict[str, tuple[str, ...]]], weights: dict[str, int], bonus: int = 0) -> dict[str, float]:
    """Score of each table type: weights for headers with its required, optional, key and excluding words; not below 0.

    ``bonus`` is added once if a required word was found.
    """
    low = [h.lower() for h in headers]
    out = {}
    for kind, words in patterns.items():
        hits = {group: sum(any(w in h for h in low) for w in words.get(group, ())) for group in weights}
        out[kind] = max(0.0, float(sum(weights[g] * n for g, n in hits.items()) + (bonus if hits.get("required") else 0)))
    return out


def keyword_type(headers: list[str], patterns: dict[str, dict[str, tuple[str, ...]]], weights: dict[str, int], per_header: int, approve_below: float, bonus: int = 0) -> tuple[str | None, float, bool]:
    """(type, confidence in percent, needs approval) of the best score; the first of equals."""
    scores = keyword_scores(headers, patterns, weights, bonus)
    if not scores or not headers:
        return None, 0.0, True
    kind = max(scores, key=scores.get)
    confidence = min(100.0, 100.0 * scores[kind] / (per_header * len(headers)))
    return (kind if scores[kind] else None), confidence, confidence < approve_below


#: Weights of the two keyword classifiers.
CLASSIFIER_A = ({"required": 15, "optional": 5, "keywords": 3, "exclude": -10}, 10, 75.0, 20)
CLASSIFIER_B = ({"required": 20, "optional": 10, "keywords": 5, "exclude": -15}, 15, 80.0, 0)


def registry_match(headers: list[str], registry: DataFrame, fingerprint: str, least: float = 0.8) -> DataFrame:
    """Entries (schema_fingerprint, headers, target) with this fingerprint, else those with nearly the same headers, best first."""
    mine = F.array(*[F.lit(h.strip().lower()) for h in headers])
    scored = registry.withColumn("exact", (F.col("schema_fingerprint") == fingerprint).cast("int")).withColumn("similarity", jaccard(mine, F.transform("headers", lambda h: F.lower(F.trim(h)))))
    return scored.filter((F.col("exact") == 1) | (F.col("similarity") >= least)).orderBy(F.desc("exact"), F.desc("similarity"), "schema_fingerprint")
