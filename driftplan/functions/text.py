"""Text expressions: sizes, escapes, versions, locations, commands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of the two size formats.
BINARY_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
DECIMAL_UNITS = ("B", "KB", "MB", "GB", "TB", "PB", "EB")
#: Separator of uniqueness keys.
KEY_SEPARATOR = "\u0001"
#: Characters that a shell expands within double quotes, in the order in which they are escaped.
SHELL_SPECIAL = ("\\", '"', "!", "`", "$")


def _sized(size: Column, base: int, units: tuple[str, ...]) -> Column:
    """Two digits of the double size / base**k, rounded as its exact binary value rounds (half to even), by integer arithmetic.

    A double between 1 and 1024 times 2**52 is a whole number, so nothing is lost on the way.
    """
    n = size.cast("long")
    shown = F.when(n < 0, F.lit("")).when(n < base, F.concat(n.cast("string"), F.lit(f" {units[0]}")))
    for k in range(1, 7):
        exact = (n.cast("double") / F.lit(float(base**k)) * F.lit(float(1 << 52))).cast("long")
        hundredths = exact.bitwiseAND((1 << 52) - 1) * 100
        rest = hundredths.bitwiseAND((1 << 52) - 1)
        low = F.shiftright(exact, 52) * 100 + F.shiftright(hundredths, 52)
        up = (rest > 1 << 51) | ((rest == 1 << 51) & (low % 2 == 1))
        near = low + up.cast("long")
        text = F.concat(F.floor(near / 100).cast("string"), F.lit("."), F.lpad((near % 100).cast("string"), 2, "0"), F.lit(f" {units[k]}"))
        shown = shown.when(n < base ** (k + 1), text) if k < 6 else shown.when(n.isNotNull(), text)
    return shown


def binary_size(size: Column) -> Column:
    """Bytes for people, by 1024."""
    return _sized(size, 1024, BINARY_UNITS)


def decimal_size(size: Column) -> Column:
    """Bytes for people, by 1000."""
    return _sized(size, 1000, DECIMAL_UNITS)


def sanitized(path: Column) -> Column:
    """Control characters other than tab as \\uXXXX."""
    code = lambda c: F.ascii(c)
    control = lambda c: (((code(c) < 32) & (code(c) != 9)) | code(c).between(127, 159)) & (F.length(c) > 0)
    return F.array_join(F.transform(F.split(path, ""), lambda c: F.when(control(c), F.concat(F.lit("\\u"), F.lpad(F.hex(code(c)), 4, "0"))).otherwise(c)), "")


def shell_escaped(path: Column) -> Column:
    for c in SHELL_SPECIAL:
        path = F.replace(path, F.lit(c), F.lit("\\" + c))
    return path


def version_at_least(version: Column, least: tuple[int, int, int]) -> Column:
    """Whether a version of exactly three numbers, with or without a v before it, is ``least`` or later. Anything else: false."""
    parts = F.split(F.regexp_replace(F.trim(version), "^v", ""), r"\.", -1)
    numbers = [F.get(parts, F.lit(i)).try_cast("int") for i in range(3)]
    sound = (F.size(parts) == 3) & numbers[0].isNotNull() & numbers[1].isNotNull() & numbers[2].isNotNull()
    return F.coalesce(sound & (F.struct(*[n.alias(f"n{i}") for i, n in enumerate(numbers)]) >= F.struct(*[F.lit(n).alias(f"n{i}") for i, n in enumerate(least)])), F.lit(False))


def location(arg: Column) -> Column:
    """A local path or [user@]host:[port:]path as struct(is_remote, user, host, port, path, error)."""
    local = (arg != "") & (arg.rlike(r"^(/|\./|\.\./)") | ~F.contains(arg, F.lit(":")))
    spec, rest = F.regexp_extract(arg, r"^([^:]*):", 1), F.regexp_extract(arg, r"^[^:]*:(?s)(.*)$", 1)
    user = F.when(F.contains(spec, F.lit("@")), F.regexp_extract(spec, r"^([^@]*)@", 1)).otherwise(F.lit(""))
    host = F.when(F.contains(spec, F.lit("@")), F.regexp_extract(spec, r"^[^@]*@(.*)$", 1)).otherwise(spec)
    number = F.regexp_extract(rest, r"^([+-]?[0-9]+):", 1).try_cast("int")
    port = F.when((number > 0) & (number <= 65535), number)
    path = F.when(port.isNotNull(), F.regexp_extract(rest, r"^[^:]*:(?s)(.*)$", 1)).otherwise(rest)
    error = F.when(arg == "", F.lit("empty path argument")).when(local, F.lit(None)).when(host == "", F.lit("empty host")).when(path == "", F.lit("empty path"))
    fine = error.isNull()
    remote = fine & ~local
    return F.struct(
        remote.alias("is_remote"), F.when(remote, user).otherwise(F.lit("")).alias("user"), F.when(remote, host).otherwise(F.lit("")).alias("host"),
        F.when(remote, F.coalesce(port, F.lit(0))).otherwise(F.lit(0)).alias("port"), F.when(remote, path).when(fine, arg).otherwise(F.lit("")).alias("path"), error.alias("error"),
    )


def ssh_address(loc: Column) -> Column:
    return F.concat(loc["host"], F.lit(":"), F.when(loc["port"] == 0, F.lit("22")).otherwise(loc["port"].cast("string")))


def ssh_spec(loc: Column) -> Column:
    return F.when(loc["user"] != "", F.concat(loc["user"], F.lit("@"), loc["host"])).otherwise(loc["host"])


def ssh_arguments(loc: Column, key: Column, subsystem: Column | None = None) -> Column:
    """Arguments of an ssh command: user, port and key where given, then a plain session or a subsystem."""
    option = lambda flag, value, given: F.when(given, F.array(F.lit(flag), value)).otherwise(F.array().cast("array<string>"))
    last = F.array(F.lit("-T"), loc["host"]) if subsystem is None else F.array(F.lit("-s"), loc["host"], subsystem)
    return F.concat(option("-l", loc["user"], loc["user"] != ""), option("-p", loc["port"].cast("string"), loc["port"] != 0), option("-i", key, key != ""), last)


def octal_unescaped(path: Column) -> Column:
    """Three-digit octal escapes, as mount tables write them for blanks, tabs, line ends and backslashes."""
    parts = F.split(path, r"(?=\\[0-7]{3})")
    one = lambda p: F.when(p.rlike(r"^\\[0-7]{3}"), F.concat(F.chr(F.conv(F.substring(p, 2, 3), 8, 10).cast("int")), F.substring(p, F.lit(5), F.length(p)))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")


def parallelism(cpus: Column) -> Column:
    """How a scan of two sides was shared among CPUs: half each, one less on the first side for an even number."""
    half = F.floor(cpus / 2)
    return F.when(cpus > 3, F.struct(F.when(cpus % 2 == 0, half - 1).otherwise(half).cast("long").alias("source"), half.cast("long").alias("destination"))).otherwise(F.struct(F.lit(1).cast("long").alias("source"), F.lit(1).cast("long").alias("destination")))


def meta_shown(size: Column, mtime: Column) -> Column:
    """A file's size and time in words, in the session's time zone."""
    at = F.date_format(F.timestamp_seconds(mtime), "yyyy-MM-dd HH:mm:ss Z z")
    return F.concat(F.lit("{size: "), size.cast("string"), F.lit(", modified: "), at, F.lit("}"))


def digest_shown(ext: Column, size: Column, hash_: Column) -> Column:
    return F.concat_ws("/", ext, size.cast("string"), hash_)


def key_shown(ext: Column, size: Column) -> Column:
    return F.concat_ws("/", ext, size.cast("string"))


def shard_bounds(n: Column, parts: Column) -> Column:
    """The half-open ranges that ``n`` items are cut into for ``parts`` workers: array of (part, start, end)."""
    at = lambda i: F.floor(i * n / parts).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda i: F.struct(i.alias("part"), at(i).alias("start"), at(i + 1).alias("end")))


def progress(done: Column, expected: Column) -> Column:
    """Whole percent, rounded half to even."""
    return F.concat(F.bround(done * F.lit(100.0) / expected).cast("long").cast("string"), F.lit("%"))


def errors_joined(message: Column, errors: Column) -> Column:
    """A message and all errors behind it; every error is followed by a comma and a blank."""
    return F.concat(message, F.lit(": "), F.array_join(F.transform(errors, lambda e: F.concat(e, F.lit(", "))), ""))
