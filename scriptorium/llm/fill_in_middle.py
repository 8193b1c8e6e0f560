"""Fill-in-middle by overlapping chunks: count boundaries, sum, rescan the owners of the cuts.

A text is cut into units (a word with the white space before it; white space at the end is
a unit of its own) by a predicate on two adjacent characters: a unit ends between a
character that is no white space and one that is, and at the end of the text. White space
is ASCII, so the predicate holds on UTF-8 bytes as well as on characters, and a chunk of
bytes that reaches one byte into the next one counts its boundaries without its
neighbours.

A text of one chunk is counted and cut where it lies. A longer one is cut into overlapping
chunks, which are dealt over all tasks and counted in parallel; prefix sums over the counts
say which chunk owns each of the two cuts, and only these chunks are read again for the
places of the cuts. Places are bytes and code points. Cuts depend on id and text alone, so
the chunks of repeated rows are the same ones and are counted once; the key of a document
is its id and the digest of its text, and no row numbers are needed that a lost executor
could deal anew.

The output is made of the places on the JVM's side: plain, prefix-suffix-middle or
suffix-prefix-middle, by hashes of seed and id.

Defined cases: null and empty texts have no units and stay plain, as do texts with a
sentinel inside; a null id is hashed as the empty string; repeated rows are formatted
alike; an empty table gives an empty result; further columns are ignored, whatever their
names.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.arrow import map_arrow
from scriptorium.session import table

#: Bytes of a chunk; a chunk overlaps the next one by a byte.
CHUNK = 32 << 10
SEED = 42
#: Sentinels, and shares of a hundred.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_RATE, SPM_RATE = 50, 80

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def boundaries(chunk: bytes) -> np.ndarray:
    """Places between a byte that is no white space and one that is, as bytes before them."""
    blank = _BLANK[np.frombuffer(chunk, dtype=np.uint8)]
    return np.flatnonzero(~blank[:-1] & blank[1:]) + 1


def characters(piece: bytes) -> int:
    """Code points that begin in a piece of UTF-8."""
    return int(np.count_nonzero((np.frombuffer(piece, dtype=np.uint8) & 0xC0) != 0x80))


def cut_at(text: bytes, ends: np.ndarray, unit: int) -> int:
    """Bytes of the first ``unit`` units of a text with these inner boundaries."""
    return 0 if unit == 0 else len(text) if unit > len(ends) else int(ends[unit - 1])


def _ranks(units: Column) -> tuple[Column, Column]:
    """The smaller and the larger cut of a text of so many units, in units."""
    one, two = F.col("__h1") % (units + 1), F.col("__h2") % (units + 1)
    return F.least(one, two), F.greatest(one, two)


def _short_step(batch: pa.RecordBatch) -> dict:
    made: dict[str, list] = {c: [] for c in ("n", "__from", "__to", "prefix_chars", "middle_chars")}
    for body, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("__body", "__h1", "__h2")), strict=True):
        ends = boundaries(body)
        n = len(ends) + 1 if body else 0
        lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
        begin, end = cut_at(body, ends, lo), cut_at(body, ends, hi)
        for c, v in zip(made, (n, begin, end, characters(body[:begin]), characters(body[begin:end])), strict=True):
            made[c].append(v)
    return {c: batch.column(c) for c in ("doc_id", "__body", "__h3", "__h4")} | made


def _count_step(batch: pa.RecordBatch, size: int) -> dict:
    bodies = batch.column("__piece").to_pylist()
    return {c: batch.column(c) for c in ("doc_id", "__digest", "__chunk")} | {
        "__ends": [len(boundaries(b)) for b in bodies],
        "__chars": [characters(b[:size]) for b in bodies],
    }


def _rescan_step(batch: pa.RecordBatch) -> dict:
    places, chars = [], []
    for piece, rank in zip(batch.column("__piece").to_pylist(), batch.column("__nth").to_pylist(), strict=True):
        at = int(boundaries(piece)[rank - 1])
        places.append(at)
        chars.append(characters(piece[:at]))
    return {c: batch.column(c) for c in ("doc_id", "__digest", "__which", "__chunk")} | {"__at": places, "__chars_at": chars}


def _long_cuts(long: DataFrame, size: int) -> DataFrame:
    """(doc_id, __digest, n, __from, __to, prefix_chars, middle_chars) of texts of many chunks."""
    key = ["doc_id", "__digest"]
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("__body") - 1) / size).cast("int"))
    chunks = long.select(*key, "__h1", "__h2", "__body", F.explode(starts).alias("__chunk")).select(
        *key, "__chunk", F.substring("__body", F.col("__chunk") * size + 1, F.lit(size + 1)).alias("__piece")
    )
    dealt = chunks.repartition("doc_id", "__digest", "__chunk")
    kinds = {f.name: f.dataType.simpleString() for f in long.schema}
    head = f"doc_id {kinds['doc_id']}, __digest binary"
    counted = map_arrow(dealt, f"{head}, __chunk int, __ends long, __chars long", partial(_count_step, size=size), column="__piece")
    counted = counted.groupBy(*key, "__chunk").agg(F.min("__ends").alias("__ends"), F.min("__chars").alias("__chars"))  # repeated rows have the same chunks
    before = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.withColumns({"__e": F.coalesce(F.sum("__ends").over(before), F.lit(0)), "__c": F.coalesce(F.sum("__chars").over(before), F.lit(0))})
    totals = counted.groupBy(*key).agg((F.sum("__ends") + 1).alias("n"), F.sum("__chars").alias("__all"))
    hashed = long.select(*key, "__h1", "__h2", F.octet_length("__body").cast("long").alias("__bytes")).distinct()
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["__digest"] == b["__digest"])
    lo, hi = _ranks(F.col("n"))
    totals = totals.join(hashed, same(totals, hashed)).select(
        totals["doc_id"], totals["__digest"], "n", "__all", "__bytes", F.explode(F.array(F.struct(F.lit(0).alias("__which"), lo.alias("__unit")), F.struct(F.lit(1).alias("__which"), hi.alias("__unit")))).alias("__cut")
    ).select(*key, "n", "__all", "__bytes", "__cut.*")
    # The owner of a cut is the chunk whose sum before is below it and whose sum with its own count is not.
    owner = same(totals, sums) & (F.col("__unit") > F.col("__e")) & (F.col("__unit") <= F.col("__e") + F.col("__ends"))
    owned = totals.where("__unit > 0 and __unit < n").join(sums, owner).select(
        totals["doc_id"], totals["__digest"], "__which", "__chunk", (F.col("__unit") - F.col("__e")).alias("__nth"), F.col("__c").alias("__c")
    )
    pieces = same(long, owned)
    asked = long.select(*key, "__body").join(owned, pieces).select(
        owned["doc_id"], owned["__digest"], "__which", "__chunk", "__nth", F.substring("__body", F.col("__chunk") * size + 1, F.lit(size + 1)).alias("__piece")
    )
    found = map_arrow(asked, f"{head}, __which int, __chunk int, __at long, __chars_at long", _rescan_step, column="__piece")
    found = found.groupBy(*key, "__which").agg(F.min("__chunk").alias("__chunk"), F.min("__at").alias("__at"), F.min("__chars_at").alias("__chars_at"))
    placed = found.join(owned.select(F.col("doc_id").alias("__id"), F.col("__digest").alias("__dig"), F.col("__which").alias("__w"), "__c"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__dig")) & (F.col("__which") == F.col("__w")))
    placed = placed.select(*key, "__which", (F.col("__chunk").cast("long") * size + F.col("__at")).alias("__byte"), (F.col("__c") + F.col("__chars_at")).alias("__char"))
    ends = totals.where("__unit = 0 or __unit = n").select(
        *key, "__which", F.when(F.col("__unit") == 0, 0).otherwise(F.col("__bytes")).alias("__byte"), F.when(F.col("__unit") == 0, 0).otherwise(F.col("__all")).alias("__char")
    )
    both = placed.unionByName(ends).groupBy(*key).agg(
        *[F.max(F.when(F.col("__which") == w, F.col(c))).alias(f"{c}{w}") for w in (0, 1) for c in ("__byte", "__char")]
    )
    units = totals.groupBy(*key).agg(F.max("n").alias("n"))
    return both.join(units, same(both, units)).select(
        both["doc_id"], both["__digest"], "n", F.col("__byte0").alias("__from"), F.col("__byte1").alias("__to"), F.col("__char0").alias("prefix_chars"), (F.col("__char1") - F.col("__char0")).alias("middle_chars")
    )


def transform(documents: DataFrame, seed: int = SEED, size: int = CHUNK) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, output) of ``documents(doc_id, text)``."""
    word = lambda k: F.conv(F.substring("__hex", 8 * k + 1, 8), 16, 10).cast("long").alias(f"__h{k + 1}")
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents.select("doc_id", body.alias("__body"), hexed.alias("__hex")).select("doc_id", "__body", *map(word, range(4)))
    kind = documents.schema["doc_id"].dataType.simpleString()
    short = map_arrow(
        rows.where(F.octet_length("__body") <= size),
        f"doc_id {kind}, __body binary, __h3 long, __h4 long, n long, __from long, __to long, prefix_chars long, middle_chars long",
        _short_step,
        column="__body",
    )
    long = rows.where(F.octet_length("__body") > size).withColumn("__digest", F.unhex(F.sha2("__body", 256)))
    cuts = _long_cuts(long, size)
    long = long.join(cuts, long["doc_id"].eqNullSafe(cuts["doc_id"]) & (long["__digest"] == cuts["__digest"])).select(
        long["doc_id"], *[c for c in short.columns if c != "doc_id"]
    )
    made = short.unionByName(long)
    text = F.col("__body").cast("string")
    plain = (F.octet_length("__body") == 0) | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (F.col("__h3") % 100 >= FIM_RATE)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < SPM_RATE, "spm").otherwise("psm")
    part = lambda a, b: F.substring("__body", a + 1, b - a).cast("string")
    begin, end, size_of = F.col("__from").cast("int"), F.col("__to").cast("int"), F.octet_length("__body")
    prefix, middle, suffix = part(F.lit(0), begin), part(begin, end), part(end, size_of)
    output = (
        F.when(F.col("form") == "plain", text)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    unless_plain = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    return made.withColumn("form", form).select("doc_id", text.alias("text"), "n", "form", unless_plain("prefix_chars"), unless_plain("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output. Texts that are not plain hold no sentinel, so each is found once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document formatted, and restored from what was written."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return transform(documents).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
    CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM hashed
), cuts AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n,
    least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid,
    array_to_string(u[hi + 1:], '') AS suf FROM cuts
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
