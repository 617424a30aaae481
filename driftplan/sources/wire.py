"""Agent messages as tables: JSON lines with a type and a base64 payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WALK = "files map<string,struct<size:bigint,modified_timestamp:bigint>>, dirs map<string,bigint>, total_size bigint"
RESULTS = "results array<struct<index:bigint,success:boolean,error:string>>"
#: The agent's names for actions.
SPEC_TYPES = {"touch": "timestamp", "mkdir": "mkdir", "move": "move", "copy": "copy"}
DIGESTS = "digests map<string,struct<file_extension:string,file_size:bigint,file_fuzzy_hash:string>>"


def envelope(kind: str, payload: Column) -> Column:
    return F.to_json(F.struct(F.lit(kind).alias("type"), F.base64(payload.cast("binary")).alias("payload")))


def payloads(lines: DataFrame, kind: str, schema: str, column: str = "value") -> DataFrame:
    """The payloads of one type of message, read by ``schema``, a column per field."""
    message = F.from_json(F.col(column), "type string, payload string")
    return lines.select(message.alias("m")).where(F.col("m.type") == kind).select(F.from_json(F.unbase64("m.payload").cast("string"), schema).alias("p")).select("p.*")


def walk_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, size, mtime, is_dir) from walk responses."""
    walk = payloads(lines, "walk_response", WALK, column)
    files = walk.select(F.explode("files").alias("path", "f")).select("path", F.col("f.size").alias("size"), F.col("f.modified_timestamp").alias("mtime"), F.lit(False).alias("is_dir"))
    return files.unionByName(walk.select(F.explode("dirs").alias("path", "mtime")).select("path", F.lit(0).cast("long").alias("size"), "mtime", F.lit(True).alias("is_dir")))


def digest_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, ext, size, fuzzy_hash) from digest responses."""
    rows = payloads(lines, "digest_response", DIGESTS, column).select(F.explode("digests").alias("path", "d"))
    return rows.select("path", F.col("d.file_extension").alias("ext"), F.col("d.file_size").alias("size"), F.col("d.file_fuzzy_hash").alias("fuzzy_hash"))


def walk_lines(inventory: DataFrame, per_message: int = 10_000) -> DataFrame:
    """Walk responses of at most about ``per_message`` entries each (column value); no message holds the whole tree."""
    pack = F.pmod(F.xxhash64("path"), F.lit(1 << 20))
    files = F.map_from_entries(F.collect_list(F.when(~F.col("is_dir"), F.struct("path", F.struct("size", F.col("mtime").alias("modified_timestamp"))))))
    dirs = F.map_from_entries(F.collect_list(F.when(F.col("is_dir"), F.struct("path", "mtime"))))
    parts = F.greatest(F.ceil(F.lit(inventory.count()) / F.lit(per_message)), F.lit(1))
    grouped = inventory.groupBy(F.pmod(pack, parts).alias("part")).agg(files.alias("files"), dirs.alias("dirs"), F.sum("size").alias("total_size"))
    return grouped.select(envelope("walk_response", F.to_json(F.struct("files", "dirs", "total_size"))).alias("value"))


def perform_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(index, success, error) from perform responses; an error that was left out is null."""
    rows = payloads(lines, "perform_response", RESULTS, column).select(F.explode("results").alias("r"))
    return rows.select("r.index", "r.success", "r.error")


def progress_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    """(kind, done, total) from the progress messages of scans and digests; a scan has no total."""
    walks = payloads(lines, "walk_progress", "files_found bigint", column).select(F.lit("walk").alias("kind"), F.col("files_found").alias("done"), F.lit(None).cast("long").alias("total"))
    return walks.unionByName(payloads(lines, "digest_progress", "files_hashed bigint, total bigint", column).select(F.lit("digest").alias("kind"), F.col("files_hashed").alias("done"), "total"))


def error_rows(lines: DataFrame, column: str = "value") -> DataFrame:
    return payloads(lines, "error", "message string", column)


#: What messages leave out, by a field's type.
EMPTY = {"string": "", "bigint": 0, "boolean": False}


def _given(value: Column, kind: str) -> Column:
    """Null for what messages leave out. A text that reads like a zero or like false is a text."""
    return F.when(value != F.lit(EMPTY[kind]).cast(kind), value)


def action_specs(actions: DataFrame, root: str, reflink: bool = False) -> DataFrame:
    """Actions with a column spec, what an agent is asked to perform below ``root``. Paths of copies and directories are absolute."""
    is_ = lambda kind, value: F.when(F.col("kind") == kind, value)
    at = lambda c: F.when(F.startswith(c, F.lit("/")), c).when(c == ".", F.lit(root)).otherwise(F.concat(F.lit(root + "/"), c))
    old, new, base = F.col("from_path"), F.col("to_path"), F.lit(root)
    types = F.create_map(*[F.lit(x) for pair in SPEC_TYPES.items() for x in pair])
    fields = {
        "type": types[F.col("kind")],
        "base_path": is_("move", base),
        "from_rel_path": is_("move", old),
        "to_rel_path": is_("move", new),
        "dest_base_path": is_("touch", base),
        "dest_rel_path": is_("touch", new),
        "mod_timestamp": F.when(F.col("kind").isin("touch", "copy"), F.col("mtime")),
        "dir_path": is_("mkdir", at(new)),
        "from_abs_path": is_("copy", at(old)),
        "to_abs_path": is_("copy", at(new)),
        "use_reflink": is_("copy", F.lit(reflink)),
    }
    kinds = {"mod_timestamp": "bigint", "use_reflink": "boolean"}
    return actions.withColumn("spec", F.to_json(F.struct(*[_given(v, kinds.get(k, "string")).alias(k) for k, v in fields.items()])))


def perform_requests(specs: DataFrame, dry_run: bool, per_message: int = 10_000) -> DataFrame:
    """Perform requests of at most ``per_message`` actions each (part, value), in order; specs: emit_seq, spec."""
    part = F.floor((F.col("emit_seq") - 1) / per_message)
    held = specs.groupBy(part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("emit_seq", "spec"))).alias("held"))
    payload = F.concat(F.lit('{"actions":['), F.array_join(F.transform("held", lambda h: h["spec"]), ","), F.lit(f'],"dry_run":{str(dry_run).lower()}}}'))
    return held.select("part", envelope("perform_request", payload).alias("value"))


def request(kind: str, payload: Column | None = None) -> Column:
    """A request line; quit has no payload."""
    return F.to_json(F.struct(F.lit(kind).alias("type"))) if payload is None else envelope(kind, payload)


def walk_request(root: Column, excluded: Column, one_file_system: bool = False, progress_ms: int = 0) -> Column:
    return request("walk_request", F.to_json(F.struct(root.alias("dir_path"), excluded.alias("excluded_names"), _given(F.lit(progress_ms).cast("bigint"), "bigint").alias("progress_interval_ms"), _given(F.lit(one_file_system), "boolean").alias("one_file_system"))))


def digest_request(root: Column, files: Column) -> Column:
    return request("digest_request", F.to_json(F.struct(root.alias("base_path"), files.alias("files"))))
