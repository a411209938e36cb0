"""Operator 3: benchmark decontamination by template canonicalisation (DataFrame functions only).

Texts become token sequences (letters, numbers, currency and percent signs). Three kinds
are replaced by typed placeholders: numbers ``<num>`` (digits and number words), units ``<unit>`` after a number,
and names ``<name>`` (words with a capital letter); other tokens stay. A run of numbers or of
names is one placeholder with the list as its value, so ``John`` can become ``Mary Ann`` and ``5`` ``twenty five``.
Every window of ``window`` template tokens of the benchmark items, at least
half of them literal, is hash-joined with every window of every document. Matches on
one diagonal (document position minus item position) are one alignment. Its slots must
be filled consistently: each value of the item answers to one value in the document, so
a question with other numbers or names is caught and a chance meeting of templates is
not; at most half of the tokens may be changed slots. A capitalised word that opens a sentence may only be
spelled so for its place: it counts as a literal where it is unchanged. An alignment counts if it covers ``min_cover`` tokens (or all but one of a shorter
item), with consistent slots; with inconsistent slots only literal tokens count.

Items that their own templates could not find (short ones, titles and other texts with few
literals) are matched by windows of exact lower-cased tokens instead; an item of one or two tokens matches a
document that is nothing else.

Scale. Documents are never shuffled for the search: a token is hashed once, a window starts only where
three tokens start some window of an item, and the item windows are broadcast
while they number at most ``broadcast_windows`` (counted first), else both sides are
shuffled by window hash. Only matched alignments are regrouped.

Defined cases: null or empty texts have no window; repeated rows give the pair
once; a null doc_id or item_id is kept as null; among alignments of one pair the one with
most tokens, then the smallest position, is reported; very long texts are searched whole, in their row;
further columns, whatever their names, are ignored (``clean`` returns them as they came); empty tables give no pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import identity, on_identity, spill, unused

WINDOW = 8
MIN_COVER = 13
START = 3  # tokens that tell where a window may start
BROADCAST_WINDOWS = 500_000  # 24 bytes each
BROADCAST_ROWS = 50_000  # alignments or items, some hundred bytes each
START_BITS = 20  # of the map of window starts that is written into the plan

# Unit words recognised after a number, and number words.
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "feet", "mile", "miles", "mg", "g", "kg", "lb", "oz", "ton", "tons",
         "ml", "l", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days",
         "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cents",
         "percent", "degrees", "mph", "kmh", "watts", "volts")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve",
           "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty",
           "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million")
TOKEN = r"\p{L}+|[0-9]+(?:[.,][0-9]+)*|[%$€£]"
SLOTS = ("<num>", "<unit>", "<name>")
RUNS = ("<num>", "<name>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body`` (also within lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def kind(x: Column, before: Column) -> Column:
    """Template token of ``x``, whose previous token is ``before``."""
    def placed(low: Column) -> Column:
        after_number = before.between("0", ":") | F.lower(before).isin(*NUMBERS)
        return (F.when(x < ":", F.when(x >= "0", "<num>").otherwise("<unit>"))  # digits come before ':', signs before digits
                .when(low.isin(*NUMBERS, *UNITS), F.when(low.isin(*NUMBERS), "<num>").when(F.coalesce(after_number, F.lit(False)), "<unit>")
                      .when(low != x, "<name>").otherwise(low))
                .when(low != x, "<name>").when(x.isin("€", "£"), "<unit>").otherwise(x))
    return let(F.lower(x), placed)


def hashes(text: Column) -> Column:
    """Hashed template tokens of a text, a run of numbers or names as one."""
    runs = [F.xxhash64(F.lit(r)) for r in RUNS]

    def collapse(h: Column) -> Column:
        return F.filter(h, lambda x, i: ~x.isin(*runs) | (F.get(h, i - 1).isNull()) | (F.get(h, i - 1) != x))
    return let(let(tokens(text), lambda t: F.transform(t, lambda x, i: F.xxhash64(kind(x, F.get(t, i - 1))))), collapse)


def exact_hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(F.lower(x)))


def template(text: Column) -> Column:
    """array<struct<c: template token, v: its lower-cased value, o: opens a sentence>> of a text."""
    marked = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN + "|[.!?]"), F.lit(0))
    ends = (".", "!", "?")
    opening = let(marked, lambda m: F.filter(F.transform(m, lambda x, i: F.struct(
        x.alias("x"), ((i == 0) | F.get(m, i - 1).isin(*ends)).alias("o"))), lambda s: ~s["x"].isin(*ends)))
    kinds = let(opening, lambda t: F.transform(t, lambda s, i: F.struct(
        kind(s["x"], F.get(t, i - 1)["x"]).alias("c"), F.lower(s["x"]).alias("v"), s["o"].alias("o"))))

    def runs(t: Column) -> Column:
        starts = F.filter(F.transform(t, lambda s, i: F.when(
            (i > 0) & s["c"].isin(*RUNS) & (F.get(t, i - 1)["c"] == s["c"]), -1).otherwise(i)), lambda i: i >= 0)
        return let(starts, lambda st: F.transform(st, lambda s, m: F.struct(
            F.get(t, s)["c"].alias("c"),
            F.array_join(F.transform(F.slice(t, s + 1, F.coalesce(F.get(st, m + 1), F.size(t)) - s), lambda y: y["v"]), " ").alias("v"),
            (F.get(t, s)["o"] & (F.coalesce(F.get(st, m + 1), F.size(t)) - s == 1)).alias("o"))))
    return let(kinds, runs)


def is_slot(c: Column) -> Column:
    return c.isin(*SLOTS)


def item_windows(h: Column, w: Column) -> Column:
    """array<struct<s: start hash, h: window hash, j: position from 0>> of an item's windows of ``w`` tokens."""
    return F.when(F.size(h) >= w, F.transform(F.sequence(F.lit(1), F.size(h) - w + 1), lambda i: F.struct(
        start_key(h, i - 1).alias("s"), F.xxhash64(F.slice(h, i, w)).alias("h"), (i - 1).alias("j"))))


def start_key(h: Column, i: Column) -> Column:
    return F.xxhash64(*[F.get(h, i + k) for k in range(START)])


def slot_of(key: Column) -> Column:
    return F.shiftrightunsigned(key, 64 - START_BITS)


def start_map(grams: DataFrame) -> Column:
    """A bitmap over hashed window starts, 2**14 longs whatever the benchmark's size: a place without its bit starts no
    window of an item. (A full map lets every window through to the join.)"""
    bits = [0] * (1 << START_BITS - 6)
    for r in grams.select(slot_of(F.col("s")).alias("k")).groupBy(F.shiftright("k", 6).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("k").bitwiseAND(63).cast("int"))).alias("bits")).collect():
        bits[r["word"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def document_windows(h: Column, lengths: list[int], starts: Column) -> Column:
    """array<struct<h: window hash, p: position from 0>> of the windows of a document that some item window may equal."""
    def known(hh: Column, i: Column) -> Column:
        return let(slot_of(start_key(hh, i)), lambda k: F.call_function(
            "shiftright", F.get(starts, F.shiftright(k, 6).cast("int")), k.bitwiseAND(63).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)

    def of(hh: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(hh) - START, F.lit(0))), lambda i: known(hh, i))

        def cut(at: Column) -> Column:
            return F.flatten(F.array(*[F.transform(F.filter(at, lambda i: i + n <= F.size(hh)), lambda i: F.struct(  # noqa: B023 - built at once
                F.xxhash64(F.slice(hh, i + 1, F.lit(n))).alias("h"), i.alias("p"))) for n in lengths]))  # noqa: B023
        return let(places, cut)
    return let(h, of)


def search(docs: DataFrame, grams: DataFrame, hashed: Callable[[Column], Column], broadcast_windows: int) -> DataFrame:
    """Windows of documents that equal an item's: doc_id, thash, ikey, w, n, j, diagonal. ``grams`` has ikey, w, n, s, h, j."""
    lengths = sorted(r["w"] for r in grams.select("w").distinct().collect()) or [WINDOW]  # at most ``window`` values
    return (docs.select("doc_id", "thash", F.explode_outer(document_windows(hashed(F.col("text")), lengths, start_map(grams))).alias("g"))
            .select("doc_id", "thash", "g.h", "g.p").filter(F.col("h").isNotNull()).join(bounded(grams.drop("s"), broadcast_windows), "h")
            .select("doc_id", "thash", "ikey", "w", "n", "j", (F.col("p") - F.col("j")).alias("diagonal")))


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows (counted), else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_cover: int = MIN_COVER,
          broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Contaminated pairs: doc_id, thash, item_id, matched_tokens, item_tokens, n_slots, slots_changed, consistent."""
    docs = identity(docs)
    text = F.col("text").cast("string")
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), template(text).alias("it"), exact_hashes(text).alias("e"))
             .distinct().withColumn("ikey", F.xxhash64("item_id", "it", "e")).withColumn("n", F.size("it")))
    h = F.transform("it.c", lambda c: F.xxhash64(c))
    w = F.least(F.col("n") - 1, F.lit(window))
    rich = F.filter(item_windows(F.col("th"), w), lambda g: 2 * F.size(F.filter(F.slice("it.c", g["j"] + 1, w), lambda c: ~is_slot(c))) >= w)
    items = items.withColumn("th", h).withColumn("rich", F.when(F.col("n") > START, rich))
    found = F.size(F.array_distinct(F.flatten(F.transform("rich", lambda g: F.sequence(g["j"], g["j"] + w - 1)))))
    items = spill(items.withColumn("poor", F.coalesce(found < F.least(F.lit(min_cover), F.col("n") - 1), F.lit(True)) & (F.size("e") > 0)), "items")
    grams = spill(items.select("ikey", w.alias("w"), "n", F.explode("rich").alias("g")).select(
        "ikey", "w", "n", "g.s", "g.h", "g.j"), "item-windows")
    parts = [search(docs, grams, hashes, broadcast_windows).withColumn("exact", F.lit(False))]
    poor = items.filter("poor").select("ikey", F.size("e").alias("n"), "e")
    if not poor.isEmpty():
        we = F.least(F.col("n"), F.lit(window))
        exact = spill(poor.filter(F.col("n") >= START).select("ikey", we.alias("w"), "n", "e", F.explode(item_windows(F.col("e"), we)).alias("g")).select(
            "ikey", "w", "n", "g.s", "g.h", "g.j"), "exact-windows")
        parts.append(search(docs, exact, exact_hashes, broadcast_windows).withColumn("exact", F.lit(True)))
        tiny = poor.filter(F.col("n") < START).select("ikey", "n", F.xxhash64("e").alias("h"))
        # by size first: few documents are as short as these items
        whole = docs.filter(F.length("text") < 1000).select("doc_id", "thash", exact_hashes(F.col("text")).alias("e")).filter(F.size("e").between(1, START - 1))
        parts.append(whole.select("doc_id", "thash", F.xxhash64("e").alias("h")).join(bounded(tiny, broadcast_windows), "h").select(
            "doc_id", "thash", "ikey", F.col("n").alias("w"), "n", F.lit(0).alias("j"), F.lit(0).alias("diagonal"), F.lit(True).alias("exact")))
    # one row per alignment: which item positions open a matched window
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    aligned = (hits.groupBy("doc_id", "thash", "ikey", "exact", "diagonal")
               .agg(F.sort_array(F.collect_set("j")).alias("js"), F.max("w").alias("w"), F.max("n").alias("n")))
    spans = F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("w") - 1)))
    needed = F.least(F.lit(min_cover), F.when(F.col("exact"), F.col("n")).otherwise(F.col("n") - 1))
    aligned = aligned.withColumn("at", F.array_distinct(spans)).filter(F.size("at") >= needed).drop("js")
    aligned = bounded(spill(aligned, "alignments"), BROADCAST_ROWS)
    texts = docs.select(F.col("doc_id").alias("d"), F.col("thash").alias("t"), "text")
    back = texts.join(aligned, aligned["doc_id"].eqNullSafe(F.col("d")) & (aligned["thash"] == F.col("t"))).join(
        bounded(items.select("ikey", "item_id", "it"), BROADCAST_ROWS), "ikey")
    slots = let(template(F.col("text")), lambda z: F.filter(F.transform(
        F.filter("at", lambda k: is_slot(F.get("it.c", k))),
        lambda k: F.struct(F.get("it.v", k).alias("a"), F.get(z["v"], (k + F.col("diagonal")).cast("int")).alias("b"), F.get("it.o", k).alias("o"))),
        lambda s: ~(s["o"] & s["a"].eqNullSafe(s["b"]))))
    back = back.select("doc_id", "thash", "item_id", "ikey", "n", "diagonal", "at", "exact",
                       F.when(F.col("exact"), F.array().cast("array<struct<a:string,b:string,o:boolean>>")).otherwise(slots).alias("slots"))
    judged = back.select(
        "doc_id", "thash", "item_id", "ikey", "n", "diagonal", "exact", F.size("at").alias("matched"), F.size("slots").alias("n_slots"),
        F.size(F.filter("slots", lambda s: ~s["a"].eqNullSafe(s["b"]))).alias("slots_changed"),
        (F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["a"], s["b"])))) == F.size(F.array_distinct("slots.a"))).alias("consistent"))
    counted = F.when(F.col("consistent"), F.col("matched")).otherwise(F.col("matched") - F.col("n_slots"))
    good = judged.filter((counted >= needed) & (2 * F.col("slots_changed") <= F.col("matched")))
    best = good.groupBy("doc_id", "thash", "ikey").agg(F.min(F.struct(
        (-F.col("matched")).alias("k"), "diagonal", "item_id", "matched", "n", "n_slots", "slots_changed", "consistent")).alias("b"))
    return best.select("doc_id", "thash", "b.item_id", F.col("b.matched").cast("long").alias("matched_tokens"),
                       F.col("b.n").cast("long").alias("item_tokens"), F.col("b.n_slots").cast("long").alias("n_slots"),
                       F.col("b.slots_changed").cast("long").alias("slots_changed"), "b.consistent")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs``, all columns, that hold no benchmark passage."""
    d, t = unused(docs, "leak_doc"), unused(docs, "leak_hash")
    bad = leaks(docs, benchmark, **options).select(F.col("doc_id").alias(d), F.col("thash").alias(t)).distinct()
    bad = bounded(spill(bad, "leaking"), BROADCAST_WINDOWS)
    return docs.join(bad, on_identity(docs, bad, d, t), "left_anti")


ORACLE = r"""
WITH src AS (
  SELECT DISTINCT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT DISTINCT 'i', item_id, coalesce(text, '') FROM benchmark),
keyed AS (SELECT row_number() OVER () AS k, * FROM src),
marked AS (
  SELECT k, unnest(t) AS x, generate_subscripts(t, 1) AS i
  FROM (SELECT k, regexp_extract_all(text, '\p{L}+|[0-9]+(?:[.,][0-9]+)*|[%$€£]|[.!?]') AS t FROM keyed)),
opened AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY k ORDER BY i) IN ('.', '!', '?'), true) AS o FROM marked),
tok AS (SELECT *, lower(x) AS l, lag(x) OVER (PARTITION BY k ORDER BY i) AS b FROM opened WHERE x NOT IN ('.', '!', '?')),
kinds AS (
  SELECT k, i, l, o, CASE WHEN x[1] BETWEEN '0' AND '9' OR l IN ({numbers}) THEN '<num>' WHEN x IN ('%', '$', '€', '£') THEN '<unit>'
    WHEN l IN ({units}) AND (b[1] BETWEEN '0' AND '9' OR lower(b) IN ({numbers})) THEN '<unit>' WHEN l <> x THEN '<name>' ELSE l END AS c FROM tok),
runs AS (SELECT *, sum(CASE WHEN c IN ('<num>', '<name>') AND c = p THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS r
  FROM (SELECT *, lag(c) OVER (PARTITION BY k ORDER BY i) AS p FROM kinds)),
coll AS (SELECT k, r, any_value(c) AS c, string_agg(l, ' ' ORDER BY i) AS v, count(*) = 1 AND bool_and(o) AS o FROM runs GROUP BY k, r),
seqs AS (SELECT k, list(c ORDER BY r) AS c, list(v ORDER BY r) AS v, list(o ORDER BY r) AS o, count(*) AS n FROM coll GROUP BY k),
lows AS (SELECT k, list(l ORDER BY i) AS e, count(*) AS ne FROM kinds GROUP BY k),
texts AS MATERIALIZED (SELECT k, side, id, c, v, o, n, e, ne, least(n - 1, {window}) AS w FROM seqs JOIN lows USING (k) JOIN keyed USING (k)),
items AS (SELECT * FROM texts WHERE side = 'i'),
grams AS (
  SELECT k AS ik, w, n, j, c[j + 1:j + w] AS g FROM (SELECT *, unnest(range(0, n - w + 1)) AS j FROM items WHERE n > 3)
  WHERE 2 * len(list_filter(c[j + 1:j + w], lambda x: x NOT IN ('<num>', '<unit>', '<name>'))) >= w),
reach AS (SELECT ik, count(DISTINCT a) AS m FROM (SELECT ik, unnest(range(j, j + w)) AS a FROM grams) GROUP BY ik),
poor AS (SELECT items.* FROM items LEFT JOIN reach ON ik = k WHERE coalesce(m, 0) < least({min_cover}, n - 1) OR n <= 3),
docwin AS (
  SELECT k AS dk, p, c[p + 1:p + lw] AS g
  FROM (SELECT t.k, t.c, l.w AS lw, unnest(range(0, t.n - l.w + 1)) AS p FROM texts t, (SELECT DISTINCT w FROM grams) l WHERE t.side = 'd' AND t.n >= l.w)),
egrams AS (SELECT k AS ik, w, ne AS n, j, e[j + 1:j + w] AS g FROM (SELECT k, e, ne, least(ne, {window}) AS w, unnest(range(0, ne - least(ne, {window}) + 1)) AS j FROM poor)),
edocwin AS (
  SELECT k AS dk, ne, p, e[p + 1:p + lw] AS g
  FROM (SELECT t.k, t.e, t.ne, l.w AS lw, unnest(range(0, t.ne - l.w + 1)) AS p FROM texts t, (SELECT DISTINCT w FROM egrams) l WHERE t.side = 'd' AND t.ne >= l.w)),
found AS (
  SELECT dk, ik, false AS exact, w, n, j, p - j AS diagonal FROM docwin JOIN grams USING (g)
  UNION ALL SELECT dk, ik, true, w, n, j, p - j FROM edocwin d JOIN egrams i USING (g) WHERE n > 2 OR ne = n),
cells AS (SELECT DISTINCT dk, ik, exact, n, diagonal, unnest(range(j, j + w)) AS a FROM found),
slots AS (
  SELECT c.*, it.v[a + 1] AS iv, d.v[a + diagonal + 1] AS dv,
    NOT exact AND it.c[a + 1] IN ('<num>', '<unit>', '<name>') AND NOT (it.o[a + 1] AND it.v[a + 1] IS NOT DISTINCT FROM d.v[a + diagonal + 1]) AS slot
  FROM cells c JOIN texts it ON it.k = ik JOIN texts d ON d.k = dk),
judged AS (
  SELECT dk, ik, exact, n, diagonal, count(*) AS matched, count(*) FILTER (slot) AS n_slots,
    count(*) FILTER (slot AND iv IS DISTINCT FROM dv) AS slots_changed,
    count(DISTINCT (iv, dv)) FILTER (slot) = count(DISTINCT iv) FILTER (slot) AS consistent
  FROM slots GROUP BY ALL),
good AS (
  SELECT *, row_number() OVER (PARTITION BY dk, ik ORDER BY matched DESC, diagonal, n, n_slots, slots_changed, consistent) AS r FROM judged
  WHERE matched - CASE WHEN consistent THEN 0 ELSE n_slots END >= least({min_cover}, CASE WHEN exact THEN n ELSE n - 1 END) AND 2 * slots_changed <= matched)
SELECT d.id AS doc_id, it.id AS item_id, matched AS matched_tokens, g.n AS item_tokens, n_slots, slots_changed, consistent
FROM good g JOIN texts d ON d.k = dk JOIN texts it ON it.k = ik WHERE r = 1
""".replace("{units}", ", ".join(f"'{u}'" for u in UNITS)).replace("{numbers}", ", ".join(f"'{u}'" for u in NUMBERS)).replace(
    "{window}", str(WINDOW)).replace("{min_cover}", str(MIN_COVER))
