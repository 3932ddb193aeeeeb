"""Line dedup: a segment-partition edit join over all lines, in DataFrame functions only.

A line of at least ``MIN_CHARS`` characters is removed when an equal line, or one within ``MAX_EDITS`` edits, comes
earlier (by document id, then line number) anywhere in the table. Shorter lines stay.

1. Equal lines collapse to their first occurrence, by a hash of 96 bits; lines are not moved between tasks.
2. A line is cut into ``MAX_EDITS + 1`` segments. A line within that many edits shares at least one of them, at a
   place that the lengths confine. Segments are indexed under (length, number, text); every line probes the lengths
   up to ``MAX_EDITS`` below its own at the few places possible. Index and probes are rows of one table, keyed by a
   hash. Lines so frequent that their keys would be hot take part with their first occurrence only.
3. Per key, each line is compared with the earliest one; lines that this leaves open are compared with those other
   earlier lines of the key whose letter counts are as close as the edits allow.
4. Candidates are verified by the banded bit-parallel edit distance (one machine word of ``2 * MAX_EDITS + 1`` bits
   per character), after what both have in common at the ends, in steps of an eighth, is cut off.

Defined results: null and empty texts have no lines to remove; documents without an id are left as they are; rows of
one id are one document, of which equal line numbers count as one place; a very long line is one line like any other;
other columns stay, and result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tunefathom.functions.numeric import let
from tunefathom.session import settled

MAX_EDITS = 2
MIN_CHARS = 24
#: Candidate lines are filtered by the hash of their key modulo this before they are joined: what is broadcast has at
#: most so many rows.
SLOTS = 1 << 18
#: Letters that are counted before two lines are compared. One edit changes one count, or two of them by one each.
LETTERS = "etaoinsrhdlucmpgbfvwy"
#: Lines that make up so much of all lines are told to every task: by that, at most ``1 / FREQUENT`` of them.
FREQUENT = 1e-4


def long_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, content, id) of every line that takes part; ``id`` is a hash of the content."""
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line", "content"))
    return rows.filter(F.length("content") >= MIN_CHARS).withColumn("id", F.xxhash64("content"))


def first_lines(lines: DataFrame) -> DataFrame:
    """(id, doc, line, n): the first occurrence of every content and how often it occurs. No text is shuffled."""
    firsts = lines.groupBy("id", F.hash("content").alias("check")).agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))
    return firsts.select("id", F.col("first.doc").alias("doc"), F.col("first.line").alias("line"), "n")


def without_repeats(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """The lines, of frequent ones only the first occurrence."""
    total = firsts.agg(F.sum("n").alias("n")).select(F.col("n") * FREQUENT).scalar()
    often = firsts.filter((F.col("n") > 1) & (F.col("n") >= total)).select("id", F.col("doc").alias("_doc"), F.col("line").alias("_line"))
    met = lines.join(F.broadcast(often), "id", "left")
    return met.filter(F.col("_doc").isNull() | ((F.col("doc") == F.col("_doc")) & (F.col("line") == F.col("_line")))).drop("_doc", "_line")


def segment_keys(content: Column, edits: int = MAX_EDITS) -> Column:
    """Array of (key, indexed): the line's own segments, and the substrings to look up in lines no longer than it.

    Of two lines of equal length one look-up is enough, so only later places are probed there.
    """
    parts = edits + 1

    def keys(n: Column) -> Column:
        out = []
        for shorter in range(edits + 1):
            length = n - shorter
            base, extra = F.floor(length / parts).cast("int"), length % parts
            for i in range(1, parts + 1):
                size = base + F.when(F.lit(i) > parts - extra, 1).otherwise(0)
                start = 1 + (i - 1) * base + F.greatest(F.lit(0), (i - 1) - (parts - extra))
                low, high = max(1 - i, shorter - (parts - i)), min(i - 1, shorter + (parts - i))
                for move in range(low, high + 1):
                    if shorter == 0 and move < 0:
                        continue
                    key = F.xxhash64(length, F.lit(i), F.substring(content, start + move, size))
                    out.append(F.struct(key.alias("key"), F.lit(shorter == 0 and move == 0).alias("indexed")))
        return F.array(*out)
    return keys(F.length(content))


def _trimmed(a: Column, b: Column, edits: int, use) -> Column:
    """``use`` of both strings without a common beginning and end, found in steps of an eighth of the shorter one."""
    def cut(x: Column) -> Column:
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        head = F.coalesce(*[F.when(F.left(x["a"], n * k / 8) == F.left(x["b"], n * k / 8), F.floor(n * k / 8)) for k in range(7, 0, -1)], F.lit(0)).cast("int")
        tail = F.coalesce(*[F.when(F.right(x["a"], n * k / 8) == F.right(x["b"], n * k / 8), F.floor(n * k / 8)) for k in range(7, 0, -1)], F.lit(0)).cast("int")
        tail = F.least(tail, n - head)
        return F.struct(*[F.substring(x[s], head + 1, F.length(x[s]) - head - tail).alias(s) for s in "ab"])
    longer_first = F.when(F.length(a) >= F.length(b), F.struct(a.alias("a"), b.alias("b"))).otherwise(F.struct(b.alias("a"), a.alias("b")))
    return let(let(longer_first, cut), lambda x: use(x["a"], x["b"]))


def within_edits(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Whether two strings are at most ``edits`` (1 or more) insertions, deletions and substitutions apart.

    The column of the distance matrix inside the band is a pair of bit sets (differences of +1 and -1 to the row
    before). The band moves down one row per character; the distance is followed along its lower edge until the last
    row, and along that row from there on.
    """
    width, mask = 2 * edits + 1, (1 << 2 * edits + 1) - 1

    def compare(longer: Column, shorter: Column) -> Column:
        def run(x: Column) -> Column:
            n = F.size(x["a"])
            padded = F.concat(F.array_repeat(F.lit(""), edits), x["a"], F.array_repeat(F.lit(""), width))
            shifts = [F.slice(padded, F.lit(k + 1), F.size(x["b"])).alias(f"r{k}") for k in range(width)]
            columns = F.transform(F.arrays_zip(x["b"].alias("c"), *shifts), lambda z: sum(
                (F.when(z[f"r{k}"] == z["c"], F.lit(1 << k)).otherwise(F.lit(0)) for k in range(1, width)), F.when(z["r0"] == z["c"], F.lit(1)).otherwise(F.lit(0))))
            start = F.struct(F.lit(mask & ~((1 << edits) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(edits).alias("d"), F.lit(0).alias("i"))

            def step(s: Column, x_bits: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                def rest(d0: Column) -> Column:
                    hp, hn = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(F.lit(mask))), d0.bitwiseAND(vp)
                    down = F.shiftright(d0, 1)
                    # the last row's bit once the lower edge has passed it; from the top bit down
                    below = s["i"] - (n - edits)
                    bit = F.greatest(F.lit(0), F.lit(2 * edits - 1) - below)
                    edge = 1 - F.shiftright(d0, 2 * edits)
                    row = F.call_function("shiftright", hp, bit).bitwiseAND(F.lit(1)) - F.call_function("shiftright", hn, bit).bitwiseAND(F.lit(1))
                    return F.struct(hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(F.lit(mask))).alias("vp"), down.bitwiseAND(hp).alias("vn"),
                                    (s["d"] + F.when(below < 0, edge).otherwise(row)).alias("d"), (s["i"] + 1).alias("i"))
                d0 = (x_bits.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x_bits).bitwiseOR(vn).bitwiseAND(F.lit(mask))
                return let(d0, rest)
            return F.aggregate(columns, start, step, lambda s: s["d"]) <= edits
        apart = F.length(longer) - F.length(shorter)
        letters = F.struct(F.split(longer, "").alias("a"), F.split(shorter, "").alias("b"))
        # with a side this short the band covers everything, and one edit per character is enough
        return F.when(apart > edits, False).when(F.length(longer) <= edits, True).otherwise(let(letters, run))
    return _trimmed(a, b, edits, compare)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``later`` lines of those (later, earlier) pairs that are within the edits."""
    texts = texts.select("id", "content")
    both = pairs.join(texts.toDF("earlier", "old"), "earlier").join(texts.toDF("later", "new"), "later")
    return both.filter(within_edits(F.col("old"), F.col("new"))).select(F.col("later").alias("id")).distinct()


def texts_of(ids: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, content, letters) of the wanted lines, filtered where the documents are read."""
    slots = ids.select(F.pmod("id", F.lit(SLOTS)).alias("slot")).distinct()
    near = lines.select("id", "content").withColumn("slot", F.pmod("id", F.lit(SLOTS))).join(F.broadcast(slots), "slot", "left_semi")
    counts = F.struct(*[(F.length("content") - F.length(F.replace("content", F.lit(x)))).alias(x) for x in LETTERS])
    return near.select("id", "content").distinct().join(ids, "id", "left_semi").withColumn("letters", counts)


def similar_lines(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Ids of the distinct lines that have an earlier similar one."""
    rows = without_repeats(lines, firsts).select("id", F.inline(segment_keys(F.col("content"))).alias("key", "indexed"))
    same_key = Window.partitionBy("key")
    met = rows.withColumns({"least": F.min("id").over(same_key), "most": F.max("id").over(same_key), "any": F.max("indexed").over(same_key)})
    met = settled(met.filter("least < most and any").groupBy("key", "id").agg(F.max("indexed").alias("indexed")), "line-candidates")
    ids = met.select("id").distinct()
    texts = settled(texts_of(ids, lines), "candidate-lines")
    places = firsts.join(ids, "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc", "line")).alias("place"))
    place = F.struct("place", "id")
    met = met.join(places, "id").withColumns({"earliest": F.min(place).over(same_key), "n": F.count("*").over(same_key)})
    met = settled(met.withColumn("earliest", F.col("earliest.id")), "placed-lines")
    pairs = met.filter("id <> earliest").select(F.col("id").alias("later"), F.col("earliest").alias("earlier")).distinct()
    found = settled(_verified(pairs, texts), "similar-lines")
    # what is not settled by the earliest line of the key meets the other earlier ones
    crowded = met.filter("n > 2 and id <> earliest").join(texts.select("id", "letters"), "id")
    open_lines = crowded.join(found, "id", "left_anti")
    before = crowded.select("key", F.col("id").alias("earlier"), place.alias("_place"), F.col("indexed").alias("other"), F.col("letters").alias("_letters"))
    apart = sum((F.abs(F.col("letters")[x] - F.col("_letters")[x]) for x in LETTERS), F.lit(0))
    rest = open_lines.join(before, (open_lines["key"] == before["key"]) & (F.col("_place") < place) & (F.col("indexed") | F.col("other")) & (apart <= 2 * MAX_EDITS))
    rest = rest.select(F.col("id").alias("later"), "earlier").distinct()
    return found.unionByName(_verified(rest, texts)).distinct()


def kept_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, kept): the numbers of a document's long lines that stay. Documents that keep none are missing."""
    lines = long_lines(docs, doc_id, text)
    firsts = settled(first_lines(lines), "first-lines")
    stay = firsts.join(similar_lines(lines, firsts), "id", "left_anti")
    return stay.groupBy("doc").agg(F.collect_set("line").alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """Adds ``n_lines`` and ``removed`` (numbers from 0), and replaces the text by its remaining lines.

    ``with_text=False`` leaves the text out and does not move it between tasks.
    """
    made = ["n_lines", "removed"]
    columns = [c for c in docs.columns if c not in made and (with_text or c != text)]
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    numbers = F.transform(lines, lambda x, i: F.when(F.length(x) >= MIN_CHARS, i))
    rows = docs.withColumns({"n_lines": F.size(lines), "_long": F.array_compact(numbers)}).select(*columns, "n_lines", "_long")
    joined = rows.join(kept_lines(docs, doc_id, text).withColumnRenamed("doc", "_doc"), F.col(doc_id) == F.col("_doc"), "left")
    removed = F.when(F.col(doc_id).isNotNull(), F.array_sort(F.array_except("_long", F.coalesce("kept", F.array().cast("array<int>"))))).otherwise(F.array().cast("array<int>"))
    out = joined.withColumn("removed", removed).drop("_long", "_doc", "kept")
    if not with_text:
        return out
    every = F.sequence(F.lit(0), F.col("n_lines") - 1)
    rest = let(F.split(F.col(text), "\n"), lambda x: F.array_join(F.transform(F.array_except(every, F.col("removed")), lambda i: F.get(x, i)), "\n"))
    return out.withColumn(text, F.when(F.size("removed") == 0, F.col(text)).otherwise(rest)).select(*columns, *made)


def sql() -> str:
    """The same removals from ``documents`` in DuckDB's SQL, comparing all lines of close lengths."""
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
f AS (SELECT content, length(content) AS n, min((doc_id, line)) AS place FROM l WHERE length(content) >= {MIN_CHARS} GROUP BY content),
near AS (SELECT DISTINCT b.content FROM f a JOIN f b ON a.n BETWEEN b.n - {MAX_EDITS} AND b.n + {MAX_EDITS} AND a.place < b.place AND levenshtein(a.content, b.content) <= {MAX_EDITS}),
stay AS (SELECT place FROM f WHERE content NOT IN (SELECT content FROM near)),
gone AS (SELECT doc_id, list(line ORDER BY line) AS removed FROM l WHERE length(content) >= {MIN_CHARS} AND (doc_id, line) NOT IN (SELECT place FROM stay) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(g.removed), 0) AS BIGINT) AS n_removed,
  coalesce(array_to_string(g.removed, ','), '') AS removed FROM documents d LEFT JOIN gone g USING (doc_id)"""
