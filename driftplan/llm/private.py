"""Personal data: base patterns, and contextual patterns bootstrapped from what they find."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What a candidate is part of: a run without blanks and marks; it must hold a digit or an at sign.
RUN, MARK = re.compile(r"[^\s\"'<>,;:|=]+"), re.compile(r"[0-9@]")
#: A slot needs so many digits, or an at sign, to look like an identifier; context: so many words before it.
SLOT_DIGITS, CONTEXT_WORDS, CONTEXT_CHARS = 5, 2, 80
#: A pattern needs so many different instances known to be of a kind, and such a share of all its instances, of which
#: unknown ones in a seed's shape count for ALIKE each.
SUPPORT, CONFIDENCE, ROUNDS, ALIKE = 5, 0.9, 3, 0.1


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of each base match, in order."""
    out, behind, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > behind and text[left - 1] in LOCAL:
            left -= 1
        if left < at and (m := DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            behind = m.end()
        at = text.find("@", max(at + 1, behind))
    for run in DOTTED.finditer(text):
        if run[0].count(".") >= 3:
            out += [(run.start() + x, 1, run.start() + y) for x, y in _addresses(run[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _addresses(parts: list[str]) -> Iterator[tuple[int, int]]:
    """Four numbers in a row, leftmost first, none in two; those with a part over 255 are dropped. One pass over the parts between dots."""
    at, i, starts = 0, 0, []
    for part in parts:
        starts.append(at)
        at += len(part) + 1
    while i + 3 < len(parts):
        if all(four := parts[i : i + 4]):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield starts[i], starts[i + 3] + len(four[3])
            i += 4
        else:
            i += 1


def slots(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str, str, int]]:
    """(start, end, context pattern, instance, rank of kind or -1) of everything that may be an identifier."""
    behind, covered, at = 0, -1, 0
    spans = [(a, b, k) for a, k, b in base]
    found = [(m.start(), m.end(), -1) for m in RUN.finditer(text) if MARK.search(m[0])] if MARK.search(text) else []
    for a, b, kind in sorted(spans + found, key=lambda x: (x[0], -x[2])):
        if kind < 0:
            while b > a and text[b - 1] in ".!?)":
                b -= 1
            while a < b and text[a] in "(":
                a += 1
            # spans are in order of their starts: covered is how far those reach that start before a
            while at < len(spans) and spans[at][0] <= a:
                covered, at = max(covered, spans[at][1]), at + 1
            if a < behind or covered > a or (at < len(spans) and spans[at][0] < b) or (text.count("@", a, b) == 0 and sum(c.isdigit() for c in text[a:b]) < SLOT_DIGITS):
                continue
        behind = max(behind, b)
        before = text[max(0, a - CONTEXT_CHARS) : a].split()[-CONTEXT_WORDS:]
        if len(before) == CONTEXT_WORDS:
            yield a, b, re.sub(r"[0-9]", "0", " ".join(before).lower()), re.sub(r"[^0-9a-z@]", "", text[a:b].lower()), kind


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Spans of personal data in whole texts.

    Base matches are the seeds. The two words before an identifier are a lexical pattern; patterns and instances form a
    graph. In each round a pattern scores, per kind, the share of its different instances that are known to be of that
    kind, where unknown ones in the shape of a seed of the kind weigh a tenth; patterns with enough support and confidence
    then make their other instances known. What confident patterns introduce at last, and no base match covers, is added.
    The graph is aggregated before it is exchanged, so a phrase in most documents weighs as much as its different instances.

    Null and empty texts have no spans. Whole texts are read, very long ones in a time that grows with their length. Rows
    are taken one by one, repeated ones too; a null id is carried. Of patterns that are as frequent with two kinds the
    kind listed first counts. An empty table gives an empty result. Other columns are ignored, whatever their names. Returns
    ``id_col``, base and spans (arrays of start, rank of kind, end; in code points, end exclusive), base_sha256.
    """
    span = "array<struct<start:int,kind:int,end:int>>"
    source = docs.select(F.col(id_col), F.col(text_col)).toDF("id", "text")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind)] + T._parse_datatype_string(f"base_sha256 string, base {span}, slots array<struct<start:int,end:int,pattern:string,instance:string,kind:int>>").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        spans = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        held = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("instance", pa.string()), ("kind", pa.int32())]))
        for batch, texts in pieces(batches, "text"):
            base = [base_spans(t) for t in texts]
            said = [hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in x).encode()).hexdigest() for x in base]
            cols = [
                pa.array(range(row, row + len(texts)), pa.int64()), batch.column(0), pa.array(said),
                pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x] for x in base], spans),
                pa.array([[dict(zip(("start", "end", "pattern", "instance", "kind"), s, strict=True)) for s in slots(t, x)] for t, x in zip(texts, base, strict=True)], held),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "base_sha256", "base", "slots"])

    found = cut(source.mapInArrow(run, schema), "private")
    seen = found.select("row", F.explode("slots").alias("s")).select("row", "s.*")
    learned = _patterns(cut(seen.groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "pattern-instances"), support, confidence, rounds)
    more = seen.where("kind < 0").drop("kind").join(learned, "pattern").groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    both = F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"cast(array() as {span})"))))
    return found.join(more, "row", "left").select(F.col("id").alias(id_col), "base", both.alias("spans"), "base_sha256")


def _shape(instance: Column) -> Column:
    """What an instance looks like: runs of letters as one letter, digits as zeros."""
    return F.regexp_replace(F.regexp_replace(instance, "[a-z]+", "a"), "[0-9]", "0")


def _patterns(graph: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(pattern, kind) of the confident patterns."""
    known = graph.where("kind >= 0").select("instance", "kind").distinct()
    shapes = cut(known.select(_shape(F.col("instance")).alias("shape"), "kind").distinct(), "shapes")
    best = None
    for _ in range(rounds):
        of = graph.select("pattern", "instance").join(known, "instance", "left")
        named = of.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("n"))
        every = named.groupBy("pattern").agg(F.sum("n").alias("known"))
        unknown = of.where("kind is null").groupBy("pattern", _shape(F.col("instance")).alias("shape")).agg(F.count_distinct("instance").alias("others"))
        weight = F.when(F.col("like"), F.lit(ALIKE)).otherwise(F.lit(1.0))
        scored = (
            named.where(F.col("n") >= support).join(every, "pattern").join(unknown, "pattern", "left").join(shapes.withColumn("like", F.lit(True)), ["shape", "kind"], "left")
            .groupBy("pattern", "kind").agg(F.first("n").alias("n"), (F.first("known") + F.coalesce(F.sum(F.col("others") * weight), F.lit(0.0))).alias("all"))
        )
        best = cut(scored.where(F.col("n") >= confidence * F.col("all")).groupBy("pattern").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind")), "patterns")
        known = cut(known.unionByName(graph.select("pattern", "instance").join(best, "pattern").select("instance", "kind")).distinct(), "known")
    return best


def _is(kind: int):
    return lambda span: span["kind"] == kind


def digest(found: DataFrame, id_col: str = "doc_id"):
    """Counts of base matches by kind, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(id_col, *counts, "base_sha256", said.alias("spans"))
