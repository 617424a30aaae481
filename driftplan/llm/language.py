"""Language identification by compression."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import spread

#: Bytes of text in each language's dictionary; of each sampled document pieces, spread over the whole text, of so many characters together.
DICTIONARY_BYTES, SAMPLE_CHARS, PIECES = 112_640, 2_000, 4
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts throughout a long text.
PIECE_BYTES = 4_096
ZSTD_LEVEL = 5
UNKNOWN = "und"
#: Letters, and numbers that aren't digits.
ALPHANUMERIC = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters count as blanks.
BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def folded(text: str) -> bytes:
    """Lower case, with signs and digits as blanks: what tells languages apart, not layout."""
    return text.lower().encode("utf-8", "surrogatepass").translate(BLANKED)


def lettered(text: str) -> bool:
    """Whether a text holds a letter: a character of category L. Numbers such as fractions and Roman ones are none."""
    return any(c.group().isalpha() for c in ALPHANUMERIC.finditer(text))


def fit_dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order_by: str = "doc_id", size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """One raw-content dictionary per value of ``lang_col``: text of a bounded sample, at most ``size`` bytes each.

    Documents are drawn evenly over the whole table, in an order made from a hash of ``order_by``. The languages are the
    model: their counts and samples, ``size`` bytes for each, are all that the driver sees. Rows without text or language
    teach nothing. Of long texts pieces from all over are taken. An empty table gives no dictionaries.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.length(F.trim(text_col)) > 0)).select(
        F.col(lang_col).alias("lang"), F.least(F.length(text_col), F.lit(SAMPLE_CHARS)).alias("chars"), spread(F.col(text_col), SAMPLE_CHARS, PIECES).alias("head"), F.abs(F.xxhash64(F.col(order_by).cast("string"))).alias("at")
    )
    counted = {r["lang"]: (r["n"], max(1.0, r["mean"])) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.avg("chars").alias("mean")).collect()}
    if not counted:
        return {}
    share = F.create_map(*[F.lit(x) for lang, (n, mean) in counted.items() for x in (lang, min(1.0, 2.0 * size / mean / n))])
    drawn = rows.where(F.col("at") < share[F.col("lang")] * float(1 << 63)).orderBy("at", "head")
    out: dict[str, bytes] = {}
    for r in drawn.toLocalIterator():
        have = out.get(r["lang"], b"")
        if len(have) < size:
            out[r["lang"]] = have + folded(r["head"]) + b" "
    return {k: out[k][:size] for k in sorted(out, key=lambda k: (-counted[k][0], k))}


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.001, keep: tuple[str, ...] = ()) -> DataFrame:
    """The language whose dictionary compresses each whole text best.

    A text is compressed, piece by piece, with each language's dictionary; the smallest total wins. The margin is the
    share of bytes by which the second is larger. ``score`` (0 to 1) rises with the margin; ``rejected`` marks texts with
    a margin under ``min_margin`` and those without any letter, whose language is ``und``. Null texts, empty ones and all
    texts, if there is no dictionary, are ``und`` with score 0. Very long texts are read whole. Ties go to the language with
    more training documents. Rows are taken one by one: repeated ones give equal results; a null id is carried. An empty
    table gives an empty result. ``keep`` names columns of ``docs`` to carry along; others are ignored, whatever their names.

    Returns: ``id_col``, lang_pred, score, margin, rejected, and ``keep``.
    """
    schema = T.StructType([docs.schema[c] for c in dict.fromkeys((id_col, *keep))] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    used = docs.select(*dict.fromkeys((id_col, text_col, *keep)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names = list(dictionaries)
        packers = [zstandard.ZstdCompressor(level=ZSTD_LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for k in names]
        for batch in batches:
            found = [_best(t, names, packers, min_margin) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            kept = [batch.column(batch.schema.get_field_index(f.name)) for f in schema.fields[:-4]]
            cols = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=schema.fieldNames())

    return used.mapInArrow(run, schema)


def _best(text, names, packers, min_margin) -> tuple[str, float, float, bool]:
    if not text or not names or not lettered(text):
        return UNKNOWN, 0.0, 0.0, True
    data = folded(text)
    sizes = sorted((sum(len(p.compress(data[at : at + PIECE_BYTES])) for at in range(0, len(data), PIECE_BYTES)), i, k) for i, (k, p) in enumerate(zip(names, packers, strict=True)))
    if len(sizes) == 1:
        return sizes[0][2], 1.0, 1.0, False
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][2], 0.5 + 0.5 * min(1.0, margin / 0.1), margin, margin < min_margin


def held_out(id_col: str, folds: int, fold: int):
    """Whether the CRC-32 of the id's text, modulo ``folds``, is ``fold``. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == fold


