"""Formatting, parsing and arithmetic of single values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftwood.functions.filters import valid_source_name

_ALL = 1 << 30
# Texts that stand for true, undefined and not a number in addresses.
TRUE, UNDEFINED, NAN = "", "{Undefined}", "{NaN}"
# Numbers that are shown by name.
SPECIAL_NUMBERS = (
    (9007199254740991.0, "Number.MAX_SAFE_INTEGER"), (-9007199254740991.0, "Number.MIN_SAFE_INTEGER"), (1.7976931348623157e308, "Number.MAX_VALUE"),
    (5e-324, "Number.MIN_VALUE"), (float("inf"), "+Infinity"), (float("-inf"), "-Infinity"),
)
# The path of a bucket's routing file, and intermediates a whole version.
ROUTING_SUFFIX = "/storage/storagerouting.json"
INTERMEDIATE_STEPS = 1_000_000
# What sshd writes when it refuses an address, when a key fails, and its process.
REFUSED = r"Authentication tried for (\S+) with correct key but not from a permitted host \(host=([^,]*), ip=([^,]*), required=([^)]*)\)"
FAILED_KEY = r"Failed publickey for (\S+) from (\S+) port (\d+) ssh2: \S+ (SHA256:[A-Za-z0-9+/=]+)"
PROCESS_ID = r"(?:sshd|sshd-session)\[(\d+)\]"
#: Unicode white space and line ends, for use within a class.
_WHITE = r"\s\x0b\xa0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LINE_ENDS = r"\n\r\u2028\u2029"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ellipsize(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def render_trimmed(text: Column, most_chars: int, most_lines: int) -> Column:
    """At most so many characters, then so many lines; ``...`` ends what was cut, on the
    last line that is left."""
    lines = F.split(ellipsize(text, most_chars), "\n")
    first = F.concat(F.array_join(F.slice(lines, 1, most_lines), "\n"), F.lit("..."))
    return F.when(F.size(lines) > most_lines, first).otherwise(ellipsize(text, most_chars))


def space_case(name: Column) -> Column:
    """camelCase and snake_case as words; the first letter, and the one after the first
    blank, become upper case, others stay. Runs of white space become one blank."""
    words = F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2")
    words = F.regexp_replace(words, "_([A-Za-z])", " $1")
    words = F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, _ALL))
    second = rf"(?s)^(.*?)( [^{_LINE_ENDS}])(.*)$"
    part = lambda i: F.regexp_extract(words, second, i)
    words = F.when(words.rlike(second), F.concat(part(1), F.upper(part(2)), part(3))).otherwise(words)
    return F.regexp_replace(words, f"[{_WHITE}]+", " ")


def format_date_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy/MM/dd hh:mm:ss a")


def from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))


def plain_number(number: Column) -> Column:
    """A double as JSON has it: no point where it is whole, an exponent only below 1e-6 and
    from 1e21 on."""
    size = F.abs(number)
    digits = F.regexp_replace(F.regexp_replace(number.cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", "")
    power = F.regexp_replace(F.regexp_replace(number.cast("string"), r"\.0E", "E"), "E(-?)", "e$1")
    power = F.when(size >= 1, F.replace(power, F.lit("e"), F.lit("e+"))).otherwise(power)
    whole = number.cast("decimal(38,0)").cast("string")
    return F.when(number == 0, "0").when((number == F.floor(number)) & (size < 1e21), whole).when((size >= 1e-6) & (size < 1e21), digits).otherwise(power)


def format_number_cell(number: Column, until: int | None = 2040) -> Column:
    """What a table cell shows for a number: special values by name, times from 2010 to the
    year ``until`` (None: without end) in ms as a date, else the number with separators, two
    decimals where it is not whole."""
    named = F.when(F.isnan(number), "")
    for value, name in SPECIAL_NUMBERS:
        named = named.when(number == F.lit(value), name)
    ms = lambda year: F.unix_millis(F.to_timestamp(F.lit(f"{year}-01-01 00:00:00")))
    shown = F.when(number == F.floor(number), F.format_number(number, 0)).otherwise(F.format_number(number, 2))
    is_time = (number > ms(2010)) & (number < (F.lit(float("inf")) if until is None else ms(until)))
    return F.when(number.isNull(), "").otherwise(named.when(is_time, format_date_time(from_ms(number))).otherwise(shown))


def format_text_cell(text: Column) -> Column:
    """What a table cell shows for a text: what follows ``Error:``, the label of an https
    link, else the text."""
    error = F.substring(text, len("Error:") + 1, _ALL)
    return F.when(text.isNull(), "").when(text.startswith("Error:"), error).when(text.startswith("https://"), link(text)[1]).otherwise(text)


def link(text: Column) -> tuple[Column, Column]:
    """(address, label) of ``address<label>``, or of a bare address."""
    label = F.regexp_extract(text, "<([^>]+)>", 1)
    return F.when(label != "", F.regexp_replace(text, "(?s)<[^>]+>.*$", "")).otherwise(text), F.when(label != "", label).otherwise(text)


def fill_template(template: Column, value: Column) -> Column:
    return F.replace(template, F.lit("$VALUE$"), value)


def looks_like_json(text: Column) -> Column:
    """Whether a text must be quoted to come back as a text."""
    ends = lambda a, b: text.startswith(a) & text.endswith(b)
    return text.isin("null", "true", "false", TRUE, UNDEFINED) | ends('"', '"') | ends("[", "]") | ends("{", "}") | text.rlike("^-?[0-9]")


def nice_stringify(value: Column, kind: str) -> Column:
    """Values for addresses: true is the empty text, null ``{Undefined}``, not a number
    ``{NaN}``; a text that looks like JSON is quoted, other text is left alone. ``kind`` is
    boolean, string, double or anything that JSON can hold."""
    shown = {
        "boolean": lambda x: F.when(x, TRUE).otherwise("false"),
        "string": lambda x: F.when(looks_like_json(x), F.to_json(x.cast("variant"))).otherwise(x),
        "double": lambda x: F.when(F.isnan(x), NAN).when(F.abs(x) == F.lit(float("inf")), "null").otherwise(plain_number(x)),
    }.get(kind, F.to_json)
    return _once(value, lambda x: F.when(x.isNull(), UNDEFINED).otherwise(shown(x)))


def nice_parse(text: Column) -> Column:
    """The JSON text of what ``nice_stringify`` wrote; null for undefined, "NaN" for not a
    number. What looks like JSON and is none stays a text."""
    def parsed(x: Column) -> Column:
        other = F.coalesce(F.to_json(F.when(looks_like_json(x), F.try_parse_json(x))), F.to_json(x.cast("variant")))
        return F.when(x == TRUE, "true").when(x == UNDEFINED, None).when(x == NAN, '"NaN"').otherwise(other)

    return _once(text, parsed)


def bucket_base_url(url: Column) -> Column:
    """The address of a bucket: that of its routing file without the file; null for others."""
    return F.when(url.endswith(ROUTING_SUFFIX), F.substring(url, F.lit(1), F.length(url) - len(ROUTING_SUFFIX)))


def hosted_url(url: Column) -> Column:
    """{address, port, account, bucket} of https://host[:port]/file/account/bucket and the
    routing file; all null for what is not of this form."""
    pattern = r"^https://([^:/?#]+)(?::([0-9]+))?/+file/+([^/?#]+)/+([^/?#]+)/*$"
    base = bucket_base_url(url)
    part = lambda i: F.when(base.rlike(pattern), F.regexp_extract(base, pattern, i))
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    port = F.when(part(2) == "", 443).otherwise(part(2).cast("int"))
    return F.struct(F.lower(part(1)).alias("address"), port.alias("port"), decoded(part(3)).alias("account"), decoded(part(4)).alias("bucket"))


def backblaze_bucket(url: Column) -> Column:
    """The bucket of https://host/file/bucket and the routing file, else null."""
    pattern = r"^https?://[^/?#]+/+file/+([^/?#]+)/*$"
    base = bucket_base_url(url)
    return F.when(base.rlike(pattern), F.url_decode(F.replace(F.regexp_extract(base, pattern, 1), F.lit("+"), F.lit("%2B"))))


def file_url(base: Column, path: Column) -> Column:
    """An address with each part of the path escaped; letters, digits and -_.!~*'() stay."""
    def escaped(part: Column) -> Column:
        out = F.url_encode(part)
        for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
            out = F.replace(out, F.lit(code), F.lit(plain))
        return out

    return F.concat(base, F.lit("/"), F.array_join(F.transform(F.split(path, "/"), escaped), "/"))


def replace_port(url: Column, port: Column) -> Column:
    """The https address at another port; its default port is not written."""
    head, rest = F.regexp_extract(url, r"^(https?://[^:/?#]+)", 1), F.regexp_extract(url, r"^https?://[^:/?#]+(?::[0-9]+)?(.*)$", 1)
    default = F.when(url.startswith("https:"), 443).otherwise(80)
    return F.concat(head, F.when(port == default, "").otherwise(F.concat(F.lit(":"), port.cast("string"))), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def sanitize_source_name(name: Column) -> Column:
    """A host or bucket as a folder's name; ``source`` if nothing usable is left."""
    made = F.substring(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "-"), 1, 64)
    return F.when(valid_source_name(made), made).otherwise("source")


def derived_source_name(url: Column, a: Column | None = None, b: Column | None = None) -> Column:
    """The name of a source that has none: host-port (a bucket's name at the vendor's hosts),
    and -route-a-b where it has a usable route that is not everything."""
    host = F.lower(F.regexp_extract(url, r"^https?://([^:/?#]+)", 1))
    hosted = hosted_url(url)
    end = F.when(host.endswith(".backblazeb2.com"), backblaze_bucket(url)).otherwise(F.concat(hosted["address"], F.lit("-"), hosted["port"].cast("string")))
    if a is not None and b is not None:
        usable = (a >= 0) & (b <= 1) & (a < b) & ~((a == 0) & (b == 1))
        routed = F.concat(end, F.lit("-route-"), plain_number(a.cast("double")), F.lit("-"), plain_number(b.cast("double")))
        end = F.when(usable, routed).otherwise(end)
    return sanitize_source_name(end)


def next_intermediate_version(version: Column) -> Column:
    """The next version that an intermediate takes: a millionth of its own size above, and
    a millionth above 0."""
    step = F.abs(version) / INTERMEDIATE_STEPS
    return version + F.when(step > 0, step).otherwise(1 / INTERMEDIATE_STEPS)


def normalize_content(content: Column) -> Column:
    """Bytes with \\r\\n as \\n; all other bytes stay, text or not."""
    return F.encode(F.replace(F.decode(content.cast("binary"), "ISO-8859-1"), F.lit("\r\n"), F.lit("\n")), "ISO-8859-1")


def manifest_digest(content: Column) -> Column:
    """{size, sha256} of the normalised bytes."""
    plain = normalize_content(content)
    return F.struct(F.octet_length(plain).cast("long").alias("size"), F.sha2(plain, 256).alias("sha256"))


def pair_key(fingerprint: Column, address: Column) -> Column:
    """What an entry that takes a revocation back has to name."""
    return F.concat(fingerprint, F.lit(" "), address)


def js_round(x: Column) -> Column:
    """Half up, also for negative numbers."""
    return F.floor(x + 0.5)


def round_decimals(x: Column, digits: int) -> Column:
    return js_round(x * 10**digits) / 10**digits


def http_range(header: Column, size: Column) -> Column:
    """{status, first, last} of a Range header for a blob of ``size`` bytes: 200 without a
    range, 206 with one (also of the last n bytes), 416 where it lies outside."""
    a, b = F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", 1), F.regexp_extract(header, r"^bytes=([0-9]*)-([0-9]*)$", 2)
    ok = header.rlike(r"^bytes=([0-9]+-[0-9]*|-[0-9]+)$")
    first = F.when(a != "", a.cast("long")).otherwise(F.greatest(F.lit(0).cast("long"), size - b.cast("long")))
    last = F.when(a == "", size - 1).when(b == "", size - 1).otherwise(F.least(b.cast("long"), size - 1))
    status = F.when(header.isNull() | ~ok, 200).when((first >= size) | (first > last), 416).otherwise(206)
    return F.struct(status.alias("status"), F.when(status == 206, first).when(status == 200, 0).cast("long").alias("first"), F.when(status == 206, last).when(status == 200, size - 1).cast("long").alias("last"))


def not_modified(since: Column, written: Column) -> Column:
    """If-Modified-Since, to the second."""
    return F.date_trunc("second", written) <= since


def log_line(line: Column) -> Column:
    """{process, user, ip, required, port, fingerprint} of a line of sshd: the first four of
    a refusal by address, process, port and fingerprint of a failed key, else nulls."""
    refused, failed = line.rlike(REFUSED), line.rlike(FAILED_KEY)
    of = lambda pattern, i, cond: F.when(cond, F.regexp_extract(line, pattern, i))
    process = F.when(line.rlike(PROCESS_ID), F.regexp_extract(line, PROCESS_ID, 1).cast("long"))
    return F.struct(
        process.alias("process"), of(REFUSED, 1, refused).alias("user"), of(REFUSED, 3, refused).alias("ip"), of(REFUSED, 4, refused).alias("required"),
        of(FAILED_KEY, 3, ~refused & failed).alias("port"), of(FAILED_KEY, 4, ~refused & failed).alias("fingerprint"),
    )


def picker_rank(option: Column, typed: str) -> Column:
    """Options that begin with what was typed come first: as it was typed, as its trimmed
    lower case, and the same two for the option in lower case; else shorter ones."""
    low, want = F.lower(option), typed.strip().lower()
    return F.when(option.startswith(typed), -10).when(option.startswith(want), -9).when(low.startswith(typed), -8).when(low.startswith(want), -7).otherwise(F.length(option))
