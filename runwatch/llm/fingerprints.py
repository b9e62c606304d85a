"""SimHash fingerprints and their Hamming neighbours, in DataFrame functions only.

Terms of a text are its distinct words and distinct pairs of neighbouring words; a pair, which
tells more about a text, has twice the weight of a word.  Each term votes with its weight on
every bit.  The votes are counted two bits to a sum of longs: 32 sums make 64 bits.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: 64-bit words of a fingerprint
WORDS = 2
_SPACES = "[\\x20\\x09-\\x0D]+"
_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """Signed hashes of the distinct terms: even for a word, odd for a pair."""
    parts = F.filter(F.split(text, _SPACES), lambda w: w != "")
    single = F.transform(parts, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)))
    pairs = F.zip_with(parts, F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
                       lambda a, b: F.xxhash64(a, b).bitwiseOR(F.lit(1)))
    return F.array_distinct(F.concat(single, pairs))


def votes(rows: DataFrame, keys: list[str], text: str = "text", words: int = WORDS) -> DataFrame:
    """``keys`` and one long ``_f<k>`` for each fingerprint word, for distinct ``keys``.

    A text without words has the fingerprint 0.  Rows with equal keys must have equal texts.
    """
    one = rows.select(*keys, F.explode_outer(terms(F.col(text))).alias("_t"))
    one = one.withColumn("_w", F.col("_t").bitwiseAND(F.lit(1)) + 1)
    for k in range(words):
        one = one.withColumn(f"_h{k}", F.xxhash64(F.lit(k), "_t"))
    sums = [F.sum("_w").alias("_all")]
    for k in range(words):
        sums += [F.sum(F.col("_w") * F.shiftrightunsigned(f"_h{k}", j).bitwiseAND(F.lit(_LANES)))
                 .alias(f"_s{k}_{j}") for j in range(32)]
    counted = one.groupBy(*keys).agg(*sums)

    def word(k: int) -> Column:
        bits = []
        for j in range(32):
            low = F.col(f"_s{k}_{j}").bitwiseAND(F.lit(0xFFFFFFFF))
            high = F.shiftrightunsigned(f"_s{k}_{j}", 32)
            bits += [F.when(2 * low > F.col("_all"), F.lit(1 << j)).otherwise(F.lit(0)).cast("long"),
                     F.when(2 * high > F.col("_all"),
                            F.shiftleft(F.lit(1).cast("long"), j + 32)).otherwise(F.lit(0)).cast("long")]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return counted.select(*keys, *[word(k).alias(f"_f{k}") for k in range(words)])


def as_text(words: list[Column]) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    apart = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b)])
    return 1.0 - apart / float(64 * len(a))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fingerprint`` (hexadecimal) for every row of ``docs (doc_id, text)``.

    NULL counts as the empty text, repeated rows give repeated results, other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    found = votes(rows, ["doc_id", "_h"], words=words)
    counts = rows.groupBy("doc_id", "_h").count().withColumnsRenamed({"doc_id": "_d", "_h": "_g"})
    same = found["doc_id"].eqNullSafe(counts["_d"]) & (found["_h"] == counts["_g"])
    return found.join(counts, same).select(
        "doc_id", as_text([F.col(f"_f{k}") for k in range(words)]).alias("fingerprint"),
        F.explode(F.sequence(F.lit(1), "count")).alias("_copy")).drop("_copy")


def near_fingerprints(found: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs ``a < b`` of distinct fingerprints within ``radius`` bits, and ``distance``.

    Two such fingerprints agree in at least ``blocks - radius`` blocks, so there is one table
    for each choice of that many blocks, keyed by their digits.  Documents that share a
    fingerprint are one row here; ``found`` (doc_id, fingerprint) holds the membership.
    """
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    texts = found.select("fingerprint").distinct()
    digits = F.length("fingerprint")
    cut = [F.floor(digits * i / blocks).cast("int") for i in range(blocks + 1)]
    block = [F.substring(F.col("fingerprint"), cut[i] + 1, cut[i + 1] - cut[i]) for i in range(blocks)]
    tables = F.array(*[F.xxhash64(F.lit(n), *[block[i] for i in chosen])
                       for n, chosen in enumerate(combinations(range(blocks), blocks - radius))])
    words = [F.shiftleft(_number(16 * k, 8), 32).bitwiseOR(_number(16 * k + 8, 8)) for k in range(WORDS)]
    keyed = texts.select(*[w.alias(f"w{k}") for k, w in enumerate(words)], F.explode(tables).alias("_key"))
    a = keyed.select("_key", *[F.col(f"w{k}").alias(f"a{k}") for k in range(WORDS)])
    b = keyed.select("_key", *[F.col(f"w{k}").alias(f"b{k}") for k in range(WORDS)])
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a{k}").bitwiseXOR(F.col(f"b{k}")))
                                        for k in range(WORDS)])
    first = F.struct(*[f"a{k}" for k in range(WORDS)]) < F.struct(*[f"b{k}" for k in range(WORDS)])
    pairs = a.join(b, (a["_key"] == b["_key"]) & first & (apart <= radius)).select(
        *[f"{s}{k}" for s in "ab" for k in range(WORDS)], apart.alias("distance")).distinct()
    named = {s: as_text([F.col(f"{s}{k}") for k in range(WORDS)]) for s in "ab"}
    return pairs.select(F.least(named["a"], named["b"]).alias("a"), F.greatest(named["a"], named["b"]).alias("b"),
                        "distance")


def _number(at: int, digits: int) -> Column:
    return F.conv(F.substring("fingerprint", at + 1, digits), 16, 10).cast("long")


def near_counts(found: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """``fingerprint, n_near``: for each fingerprint the other documents within ``radius`` bits.

    Documents with the very same fingerprint count too.
    """
    counts = shared.stored(found.groupBy("fingerprint").agg(F.count("*").alias("n")))
    pairs = near_fingerprints(counts, radius, blocks)
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    others = both.join(counts.select(F.col("fingerprint").alias("b"), "n"), "b").groupBy("a").agg(
        F.sum("n").alias("m"))
    return counts.join(others, F.col("fingerprint") == F.col("a"), "left").select(
        "fingerprint", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_near"))


def _same(a: Column, b: Column) -> Column:
    """Equal ids, NULL included, in a form that stays out of the keys of a join."""
    known = [F.coalesce(c, F.lit(-1 << 63)) for c in (a, b)]
    return known[0].bitwiseXOR(known[1]) == 0


def edit_report(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Fingerprints of all texts, of edited texts, and how alike they are.

    In descending order of doc_id (NULL last, ties by content) every text is followed by the
    next one, the last by the first.  The edited text has the last third of its code points
    replaced by the beginning of the following text.  Only that beginning travels.  Rows that
    agree in id and text take one place in the order and get the same result each.  Returns
    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    """
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_h", F.xxhash64("doc_id", "text"))
    narrow = base.groupBy("doc_id", "_h", F.length("text").cast("long").alias("n_chars")).agg(
        F.count("*").alias("_rows"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h").asc()]
    line = shared.stored(shared.neighbours(narrow, order, ["doc_id", "_h"]).withColumn(
        "_k", F.floor(F.col("n_chars") / 3).cast("int")))
    wanted = line.select(F.col("next_doc_id"), F.col("next__h"), F.col("doc_id").alias("_to"),
                         F.col("_h").alias("_to_h"), "_k")
    # rows meet on the content hash alone, the id is checked on top of it: so the votes below
    # find their rows where the join left them and need no further exchange
    supply = base.join(wanted, (base["_h"] == wanted["next__h"])
                       & _same(base["doc_id"], wanted["next_doc_id"]))
    heads = supply.select("_to", "_to_h", F.col("_k"), F.substring(
        F.col("text"), F.lit(1), F.col("_k")).alias("_head"))
    heads = heads.repartition("_to_h").groupBy("_to", "_to_h", "_k").agg(F.first("_head").alias("_head"))
    both = base.join(heads, (base["_h"] == heads["_to_h"]) & _same(base["doc_id"], heads["_to"]))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - F.col("_k")), F.col("_head"))
    both = both.select("doc_id", "_h", "text", edited.alias("_edited"))
    kinds = both.withColumn("_sha", F.sha2(F.col("_edited").cast("binary"), 256)).select(
        "doc_id", "_h", "_sha", F.posexplode(F.array("text", "_edited")).alias("_kind", "_text"))
    found = votes(kinds, ["doc_id", "_h", "_kind", "_sha"], "_text", words)
    pick = [F.max(F.when(F.col("_kind") == kind, F.col(f"_f{k}"))).alias(f"_{name}{k}")
            for kind, name in ((0, "own"), (1, "edit")) for k in range(words)]
    found = shared.stored(found.groupBy("doc_id", "_h", "_sha").agg(*pick))
    whole = line.join(found.withColumnsRenamed({"doc_id": "_d", "_h": "_g"}),
                      (F.col("_h") == F.col("_g")) & _same(F.col("doc_id"), F.col("_d")))
    after = found.select(F.col("doc_id").alias("_n"), F.col("_h").alias("_m"),
                         *[F.col(f"_own{k}").alias(f"_next{k}") for k in range(words)])
    whole = whole.join(after, (F.col("next__h") == F.col("_m")) & _same(F.col("next_doc_id"), F.col("_n")))
    own, edit, then = ([F.col(f"_{n}{k}") for k in range(words)] for n in ("own", "edit", "next"))
    return whole.select(
        "doc_id", "n_chars", F.col("_sha").alias("edited_sha256"), as_text(own).alias("fingerprint"),
        as_text(edit).alias("edited_fingerprint"), likeness(own, edit).alias("near_edited"),
        likeness(own, then).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "_rows")).alias("_copy")).drop("_copy")
