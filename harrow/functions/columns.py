"""Column expressions: text normalisation, path shapes, keys and tags. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest shape in bytes.
MAX_SHAPE = 512
#: Longest command in bytes.
MAX_COMMAND = 256
#: Labels that say who asked, not for what (fixed values).
AGENT_LABELS = ("ai-agent-artifact", "ai-agent-tooling")
#: Labels that say only that someone looked (fixed values).
WEAK_LABELS = ("probe", "path-scanner", "php-probe", "ai-agent-artifact", "ai-agent-tooling")
#: Labels that no rule gives: the weak ones and those of behaviour (fixed values).
UNMATCHED_LABELS = (*WEAK_LABELS, "form-interaction", "write-method", "proxy-probe", "unusual-method", "automation", "inhuman-behavior")
#: Families in their order, and the labels of each (fixed values). Other labels that end in -probe are recon, the rest other.
FAMILIES = {
    "recon": ("scanner-ua", "research-scanner", "path-scanner", "api-recon", "graphql-introspection"),
    "exposure": ("sensitive-path",),
    "inject": ("sqli", "xss", "ssti", "nosqli", "xxe", "crlf-injection"),
    "impact": ("rce", "deserialization", "ssrf", "path-traversal"),
    "interact": ("form-interaction", "write-method", "credential-attack"),
    "postex": ("webshell", "mcp-abuse"),
    "bot": ("automation", "inhuman-behavior", "proxy-probe", "unusual-method", "ai-agent-artifact", "ai-agent-tooling"),
    "other": (),
}
#: Labels that count for a family only when no other label names one (fixed values).
LAST_RESORT = ("path-scanner", "php-probe", "ai-agent-artifact", "ai-agent-tooling")
#: Commands that are counted by name (fixed values).
VERBS = ("id", "whoami", "uname", "pwd", "hostname", "echo", "ls", "cat", "cd", "ps", "wget", "curl", "chmod", "rm", "nc", "bash", "sh", "python", "perl", "php", "base64")
#: Parameters that hold a command, the first that is there counts (fixed values).
COMMAND_PARAMETERS = ("cmd", "c", "command", "exec", "execute", "run", "shell", "x")
#: Long names that are no random tokens (fixed values).
NOT_RANDOM = ("administrator", "autodiscover", "configuration", "phpmyadmin", "reportserver", "webresource", "wp-content", "wp-includes", "xmlrpc")
#: How the key of an IPv4 address begins.
V4 = "0" * 20 + "ffff"


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def normalize_text(c: Column) -> Column:
    """Up to two percent-decoding passes; + is a blank; %uXXXX of ASCII and overlong forms of dot and slash are folded; broken escapes stay."""
    c = F.regexp_replace(c, "(?i)%u00([0-7][0-9a-f])", "%$1")
    for overlong, plain in (("%c0%ae", "."), ("%c0%af", "/"), ("%e0%80%ae", "."), ("%e0%80%af", "/")):
        c = F.regexp_replace(c, f"(?i){overlong}", plain)
    for _ in range(2):
        escaped = F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")
        c = F.coalesce(F.try_url_decode(escaped), c)
    return c


def cut_bytes(c: Column, most: int) -> Column:
    """The longest beginning of whole characters in at most ``most`` bytes."""
    lengths = F.sequence(F.lit(most), F.lit(most // 4), F.lit(-1))
    cut = F.get(F.filter(F.transform(lengths, lambda n: F.substr(c, F.lit(1), n)), lambda s: F.octet_length(s) <= most), F.lit(0))
    return F.when(F.octet_length(c) <= most, c).otherwise(cut)


def _placeholder(s: Column) -> Column:
    """What stands for an identifier, null for a name. Case is looked at: many changes of it are a sign of a random token."""
    changes = F.regexp_count(s, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    token = (F.length(s) >= 12) & s.rlike("^[A-Za-z0-9_-]+$") & ~F.lower(s).isin(*NOT_RANDOM)
    random = token & ((s.rlike("[A-Za-z]") & s.rlike("[0-9]")) | (changes * 3 > F.length(s)))
    return (
        F.when(s.rlike("^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "{uuid}")
        .when(s.rlike("^[0-9]+$"), "{n}")
        .when(s.rlike("^[0-9A-Fa-f]{8,}$"), "{hex}")
        .when(random, "{rand}")
    )


def _segment(s: Column) -> Column:
    """A whole segment, else a file's name before its last dot, is replaced; the rest is lower-cased."""
    stem, suffix = F.regexp_extract(s, r"(?s)^(.+)\.([^.]*)$", 1), F.lower(F.regexp_extract(s, r"(?s)^(.+)\.([^.]*)$", 2))
    return F.coalesce(_placeholder(s), F.concat(F.when(stem != "", _placeholder(stem)), F.lit("."), suffix), F.lower(s))


def path_shape(path: Column) -> Column:
    """Path without query, decoded, its identifiers replaced; at most MAX_SHAPE bytes are read and given."""
    plain = cut_bytes(normalize_text(F.substring_index(path, "?", 1)), MAX_SHAPE)
    parts = F.transform(F.filter(F.split(plain, "/"), lambda s: s != ""), _segment)
    return cut_bytes(F.concat(F.lit("/"), F.array_join(parts, "/")), MAX_SHAPE)


def value_hash(c: Column) -> Column:
    """First 8 bytes of SHA-256 as a signed number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, -10).cast("bigint")


def label_family(label: Column) -> Column:
    out = None
    for family, labels in FAMILIES.items():
        if labels:
            out = (F if out is None else out).when(label.isin(*labels), family)
    return out.when(F.endswith(label, F.lit("-probe")), "recon").otherwise("other")


def label_families(labels: Column) -> Column:
    """Families of the labels in the fixed order; LAST_RESORT labels only if no other names one; ``other`` only alone."""
    every = F.array(*map(F.lit, FAMILIES))
    of = lambda xs: F.array_intersect(every, F.transform(xs, label_family))
    named = lambda fs: F.when(F.size(fs) > 1, F.array_remove(fs, "other")).otherwise(fs)
    strong = named(of(F.filter(labels, lambda x: ~x.isin(*LAST_RESORT))))
    return F.when((F.size(strong) == 0) | (F.get(strong, F.lit(0)) == "other"), named(of(labels))).otherwise(strong)


_BYTE = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_DOTTED, _GROUPS = f"{_BYTE}\\.{_BYTE}\\.{_BYTE}\\.{_BYTE}", "[0-9a-f]{1,4}(:[0-9a-f]{1,4})*"


def _hexed(dotted: Column) -> Column:
    return F.array_join(F.transform(F.split(dotted, "\\."), lambda o: F.lpad(F.lower(F.hex(o.cast("int"))), 2, "0")), "")


def _v6_key(six: Column) -> Column:
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    full = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
    short = F.contains(six, F.lit("::"))
    ends = F.struct(groups(F.substring_index(six, "::", 1)).alias("head"), F.when(short, groups(F.substring_index(six, "::", -1))).otherwise(F.array().cast("array<string>")).alias("tail"), short.alias("short"))

    def key(e: Column) -> Column:
        missing = 8 - F.size(e["head"]) - F.size(e["tail"])
        filled = F.concat(full(e["head"]), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), full(e["tail"]))
        return F.when(F.when(e["short"], missing >= 1).otherwise(missing == 0), filled)

    return F.when(six.rlike(f"^({_GROUPS})?(::({_GROUPS})?)?$"), bound(ends, key))


def ip_key(ip: Column) -> Column:
    """32 hexadecimal digits that sort as the 16-byte address; IPv4 is mapped; null for what is no address."""

    def key(low: Column) -> Column:
        tail = bound(F.regexp_extract(low, f"{_DOTTED}$", 0), lambda t: F.concat_ws(":", F.substring(_hexed(t), 1, 4), F.substring(_hexed(t), 5, 4)))
        # a dotted end of an IPv6 address is two groups
        six = F.when(low.rlike(f":{_DOTTED}$"), F.concat(F.regexp_replace(low, f"{_DOTTED}$", ""), tail)).otherwise(low)
        return F.when(low.rlike(f"^{_DOTTED}$"), F.concat(F.lit(V4), _hexed(low))).when(F.contains(low, F.lit(":")), bound(six, _v6_key))

    return bound(F.lower(ip), key)


def net_range(cidr: Column) -> tuple[Column, Column]:
    """First and last key of a network with any prefix length; host bits are dropped; null for what is no network."""
    address, given = F.substring_index(cidr, "/", 1), F.when(F.contains(cidr, F.lit("/")), F.substring_index(cidr, "/", -1)).otherwise("128")
    most = F.when(F.contains(address, F.lit(":")) | ~F.contains(cidr, F.lit("/")), 128).otherwise(32)
    parts = F.struct(ip_key(address).alias("key"), F.when(given.rlike("^[0-9]{1,3}$"), given.cast("int")).alias("bits"), most.alias("most"))

    def ends(p: Column) -> Column:
        key, length = p["key"], F.when(p["bits"] <= p["most"], p["bits"] + 128 - p["most"])
        whole = F.floor(length / 4).cast("int")
        digit = F.conv(F.substr(key, whole + 1, F.lit(1)), 16, 10).cast("int")
        step = F.pow(F.lit(2), 4 - length % 4).cast("int")  # of the digit in which the network ends
        end = lambda d, fill: F.when(length == 128, key).otherwise(F.rpad(F.concat(F.substr(key, F.lit(1), whole), F.lower(F.hex(d))), 32, fill))
        return F.struct(end(digit - digit % step, "0").alias("low"), end(digit - digit % step + step - 1, "f").alias("high"))

    both = bound(parts, ends)
    return both["low"], both["high"]


def is_v4(key: Column) -> Column:
    return F.startswith(key, F.lit(V4))


def source_key(key: Column) -> Column:
    """IPv6 sources are folded to their /64."""
    return F.when(is_v4(key), key).otherwise(F.rpad(F.substring(key, 1, 16), 32, "0"))


def prefix24_48(key: Column) -> Column:
    """The /24 of an IPv4 key, the /48 of an IPv6 one, as hexadecimal digits."""
    return F.when(is_v4(key), F.substring(key, 1, 30)).otherwise(F.substring(key, 1, 12))


def header_value(headers: Column, name: str, default: str | None = None) -> Column:
    """First header of the name, case-insensitive."""
    found = F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def extract_json(c: Column, path: str, kind: str = "string") -> Column:
    """Typed lookup; null on what is no JSON or of another type."""
    return F.try_variant_get(F.try_parse_json(c), path, kind)


def extract_command(query: Column, body: Column, names: tuple[str, ...] = COMMAND_PARAMETERS) -> Column:
    """The first of the parameters that is there, in the query or else in the form, decoded once, at most MAX_COMMAND bytes."""

    def parameter(c: Column, name: str) -> Column:
        there = c.rlike(f"(?:^|&){name}(?:=|&|$)")
        raw = F.regexp_replace(F.regexp_extract(c, f"(?:^|&){name}(?:=([^&]*))?(?:&|$)", 1), "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(there, F.coalesce(F.try_url_decode(raw), raw))

    return cut_bytes(F.coalesce(*[parameter(c, n) for n in names for c in (query, body)]), MAX_COMMAND)


def command_verb(command: Column) -> Column:
    """The command's first word without its folder, if it is counted by name."""
    verb = F.lower(F.regexp_extract(command, r"^\s*(?:\S*/)?([^\s/]*)(?:\s|$)", 1))
    return F.when(verb.isin(*VERBS), verb).otherwise("other")


def header_order_key(method: Column, version: Column, names: Column, cookies: Column, language: Column) -> Column:
    """Our own key of how a request's headers stand: method, version, flags, count, language, and hashes of header and cookie names in order.

    ``names`` are header names as sent, ``cookies`` cookie names. Equal keys come from like clients.
    """
    low = F.transform(names, lambda n: F.lower(n))
    has = lambda name: F.array_contains(low, name)
    flags = F.concat(F.when(has("cookie"), "c").otherwise("n"), F.when(has("referer"), "r").otherwise("n"))
    plain = F.filter(low, lambda n: ~n.isin("cookie", "referer"))
    short = lambda a: F.substring(F.sha2(F.array_join(a, ","), 256), 1, 12)
    accepted = F.rpad(F.substring(F.regexp_replace(F.lower(F.coalesce(language, F.lit(""))), "[^a-z]", ""), 1, 4), 4, "0")
    head = F.concat(F.lower(F.substring(method, 1, 2)), version, flags, F.lpad(F.least(F.size(plain), F.lit(99)).cast("string"), 2, "0"), accepted)
    return F.concat_ws("_", head, short(plain), short(F.array_sort(F.coalesce(cookies, F.array().cast("array<string>")))))


def intel_tags(provider: Column, data: Column) -> Column:
    """Prefixed tags from a provider's JSON."""
    tag = lambda name, path: F.when(extract_json(data, path).isNotNull(), F.concat(F.lit(f"{name}:"), F.lower(extract_json(data, path))))
    return F.array_compact(F.array(F.concat(F.lit("provider:"), provider), tag("country", "$.country"), tag("kind", "$.kind"), F.when(extract_json(data, "$.exit", "boolean"), F.lit("exit"))))


def message_line(method: Column, path: Column, status: Column, labels: Column) -> Column:
    return F.concat_ws(" ", method, path, F.concat(F.lit("->"), status.cast("string")), F.concat(F.lit("["), labels, F.lit("]")))
