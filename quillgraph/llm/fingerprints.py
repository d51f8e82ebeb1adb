"""Document fingerprints by I-Match, with DataFrame functions only.

Terms whose document frequency lies in a band form the lexicon. A text's distinct terms of the lexicon are sorted and
several randomised subsets of the lexicon are hashed; each subset is a random slice of it. Slices of three densities
are used (the first covers the whole lexicon), so that texts of any length have slices in which only a few of their terms
fall; such a slice's hash survives edits elsewhere. Likeness is the share of equal hashes among slices in which either text has a term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: (one slice has 1/density of the lexicon, number of slices)
TIERS = ((16, 16), (128, 24), (1024, 24))
EMPTY = "-"


def _order():
    return Window.partitionBy("__bucket").orderBy(F.col("doc_id").asc_nulls_first(), "__text_key")


def terms_of(text: Column) -> Column:
    """Hashes of a text's distinct terms (lower case, ASCII white space between them)."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), common.GAP)), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, low: float = 0.001, high: float = 0.1) -> DataFrame:
    """Terms (hashed) held by at least max(2, low x N) and at most max(2, high x N) of all N documents.

    A document has on average D distinct terms, so at most D / low terms can be in N x low documents: the lexicon's
    size doesn't grow with the corpus, which is why it may be broadcast.
    """
    n = docs.count()
    counts = docs.select(F.explode(terms_of(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return common.stored(counts.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term"), "lexicon")


def _part(h: Column, tier: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 3 + 16 * tier), F.lit(TIERS[tier][0]))


def _in_tier(tier: int):
    return lambda h: _part(h, tier) < TIERS[tier][1]


def _in_slice(tier: int, k: int):
    return lambda h: _part(h, tier) == k


def sliced(df: DataFrame, terms: str, whole: str, out: str) -> DataFrame:
    """Adds ``out``: the hashes of all slices of a sorted array of terms, as one string; drops ``terms`` and ``whole``.

    An empty array's slices are hashes of ``whole``. Each step is a projection of its own, so that no array is worked
    out twice.
    """
    tiers = {f"__tier{t}": F.filter(terms, _in_tier(t)) for t in range(len(TIERS))}
    owns = F.array(*[F.filter(f"__tier{t}", _in_slice(t, k)) for t, (_, count) in enumerate(TIERS) for k in range(count)])
    text = lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
    code = lambda own, k: F.when(F.col("__none"), text(F.xxhash64(whole, k))).when(F.size(own) == 0, F.lit(EMPTY)).otherwise(text(F.xxhash64(own, k)))
    steps = df.withColumns(tiers | {"__none": F.size(terms) == 0}).withColumn("__owns", owns)
    return steps.withColumn(out, F.array_join(F.transform("__owns", code), " ")).drop(terms, whole, "__none", "__owns", *tiers)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal slice hashes of two fingerprints among slices in which either has terms; equal ones: 1."""
    x, y = F.split(a, " "), F.split(b, " ")
    either = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != EMPTY) | (q != EMPTY)), lambda v: v))
    equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != EMPTY)), lambda v: v))
    return F.when(a == b, F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(equal / either).cast("double")


def fingerprint(texts: DataFrame, keys: list[str], columns: list[str], facts: list[str], lexicon_: DataFrame, few: int = 12) -> DataFrame:
    """``texts(*keys, *columns, *facts)`` -> ``(*keys, *facts, <column>_print for each column)``; keys identify rows.

    Texts with fewer than ``few`` distinct terms keep all of them; a text without any kept term has a fingerprint that
    only texts with the same terms in the same order share. A row's facts travel with the first of its exploded rows, so
    nothing is joined back; where rows are dealt out by one of the keys already, nothing is shuffled.
    """
    base = texts.select(*keys, *facts, *[terms_of(F.coalesce(c, F.lit(""))).alias(f"__t{i}") for i, c in enumerate(columns)])
    void = F.lit(None)
    first = F.array(F.struct(void.cast("int").alias("of"), F.struct(*facts, *[F.xxhash64(f"__t{i}").alias(f"__whole{i}") for i in range(len(columns))]).alias("facts"), void.cast("long").alias("term"), F.lit(False).alias("short")))
    kind = texts.select(F.struct(*facts, *[F.lit(0).cast("long").alias(f"__whole{i}") for i in range(len(columns))])).schema[0].dataType
    rest = [
        F.transform(f"__t{i}", (lambda i: lambda h: F.struct(F.lit(i).alias("of"), void.cast(kind).alias("facts"), h.alias("term"), (F.size(f"__t{i}") < few).alias("short")))(i))
        for i in range(len(columns))
    ]
    rows = base.select(*keys, F.explode(F.concat(first, *rest)).alias("__x")).select(*keys, "__x.of", "__x.facts", "__x.term", "__x.short")
    known = F.broadcast(lexicon_.select("term", F.lit(True).alias("known")))
    kept = rows.join(known, "term", "left").where("of IS NULL OR short OR known")
    lists = [F.collect_list(F.when(F.col("of") == i, F.col("term"))).alias(f"__k{i}") for i in range(len(columns))]
    out = kept.groupBy(*keys).agg(F.first("facts", ignorenulls=True).alias("facts"), *lists)
    out = out.select(*keys, "facts.*", *[F.array_sort(f"__k{i}").alias(f"__k{i}") for i in range(len(columns))])
    for i, c in enumerate(columns):
        out = sliced(out, f"__k{i}", f"__whole{i}", f"{c}_print")
    return out


def _place() -> Column:
    """What rows are ordered by: null doc_ids first, then doc_id, then 32 bits of the text's hash."""
    return F.struct(
        F.col("doc_id").isNotNull().cast("int").alias("b"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("hi"),
        F.shiftright(F.xxhash64("text"), 32).cast("int").alias("lo"))


def _number(place) -> int:
    return ((place["b"] << 64) + place["hi"] + 2**63) * 2**32 + place["lo"] + 2**31


def _cell(place: Column, starts: list[int]) -> Column:
    """Index of the last of the ascending ``starts`` that isn't above a row's place, by binary search."""
    rows = [[x >> 96, ((x >> 32) % 2**64) - 2**63, x % 2**32 - 2**31] for x in starts]
    text = "[" + ",".join(f'{{"b":{b},"hi":{hi},"lo":{lo}}}' for b, hi, lo in rows) + "]"
    table = F.from_json(F.lit(text), "array<struct<b:int,hi:bigint,lo:int>>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(starts).bit_length() - 1, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= place, at + step).otherwise(at))
    return F.greatest(found - 1, F.lit(0))


def in_order(docs: DataFrame, bucket_bytes: int = 8 << 20, cells: int = 8192) -> tuple[DataFrame, list[int]]:
    """Adds ``__bucket`` and ``__text_key``: buckets ascend by doc_id, rows within one by (doc_id, text); null doc_ids come first.

    Ranges of places are counted and those that hold too much are cut again until none does, wherever ids lie and
    whatever share of rows one id (or none) has; only rows that are equal in doc_id and text can't be told apart. A
    bucket is a run of ranges of about ``bucket_bytes``, or of a ``cells``th of the corpus where that is more, so the
    driver sees a bounded number of sums. Returns the buckets, too.
    """
    docs = docs.withColumn("__text_key", F.xxhash64("text"))
    slim = common.stored(docs.select(_place().alias("place"), (F.octet_length("text") + 64).cast("long").alias("size")), "fingerprint-places")
    low, high, total = slim.agg(F.min("place"), F.max("place"), F.sum("size")).first()
    if low is None:
        return docs.withColumn("__bucket", F.lit(0)), [0]
    goal, parts = max(bucket_bytes, -(-total // cells)), cells
    ranges, heavy = [((_number(low), _number(high) + 1), total)], {0}
    while heavy:
        cut = []
        for i, ((x, y), _) in enumerate(ranges):
            n = min(y - x, parts) if i in heavy else 1
            cut += [(x + (y - x) * j // n, x + (y - x) * (j + 1) // n) for j in range(n)]
        sizes = dict(slim.groupBy(_cell(F.col("place"), [x for x, _ in cut])).agg(F.sum("size")).collect())
        ranges = [(cut[i], sizes[i]) for i in sorted(sizes)]
        heavy = {i for i, ((x, y), size) in enumerate(ranges) if size > 2 * goal and y - x > 1}
        parts = max(2, cells // max(1, len(heavy)))
    buckets, held = [], 0
    for (x, _), size in ranges:
        if not buckets or held + size > goal:
            buckets.append(x)
            held = 0
        held += size
    common.drop(slim)
    return docs.withColumn("__bucket", _cell(_place(), buckets)), list(range(len(buckets)))


def edited_fingerprints(docs: DataFrame, low: float = 0.001, high: float = 0.1) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text, ...)`` and of their edited texts, and their likeness.

    A text's last floor(n / 4) code points are replaced by the first as many (or all) of the next document's, by
    doc_id (after the last comes the first; a lone document follows itself). Null texts count as empty; an empty text's
    fingerprint has no terms. Rows that share a doc_id are ordered by their texts. An empty table gives an empty result;
    other columns are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = lexicon(docs, low, high)
    placed, buckets = in_order(docs)
    # the first row of every bucket: one text per bucket, of which there are a bounded number
    befores = docs.sparkSession.createDataFrame([(b, (b - 1) % len(buckets)) for b in buckets], "__first int, __before int")
    key = F.struct(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), "__text_key")
    lowest = common.stored(placed.groupBy(F.col("__bucket").alias("__first")).agg(F.min(key).alias("__key")).join(F.broadcast(befores), "__first"), "bucket-keys")
    firsts = common.stored(
        placed.withColumn("__key", key).join(F.broadcast(lowest), "__key").groupBy("__before").agg(F.max("text").alias("__first_text")), "bucket-firsts")
    ahead = placed.withColumn("__pos", F.row_number().over(_order())).withColumn("__lead", F.lead("text").over(_order()))
    following = F.coalesce("__lead", "__first_text", F.lit(""))
    n = F.length("text")
    m = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - m), F.substring(following, F.lit(1), m))
    both = (
        ahead.join(F.broadcast(firsts), F.col("__bucket") == F.col("__before"), "left")
        .select("__bucket", "__pos", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
        .withColumn("edited_sha256", F.sha2("edited", 256))
    )
    prints = fingerprint(both, ["__bucket", "__pos"], ["text", "edited"], ["doc_id", "n_chars", "edited_sha256"], known)
    prints = prints.withColumnsRenamed({"text_print": "fingerprint", "edited_print": "edited_fingerprint"})
    after = Window.partitionBy("__bucket").orderBy("__pos")
    done = common.stored(prints.withColumn("__next", F.lead("fingerprint").over(after)), "fingerprints")
    heads = done.where("__pos = 1").select(F.col("__bucket").alias("__first"), F.col("fingerprint").alias("__head")).join(F.broadcast(befores), "__first").drop("__first")
    out = done.join(F.broadcast(heads), F.col("__bucket") == F.col("__before"), "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("__next", "__head", "fingerprint")).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(common.table(spark, sf_dir, "documents"))
