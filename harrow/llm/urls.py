"""URL filter: rules, and a template tree per host judged by labelled purity.

Paths are counted once each. Level by level, a host's segments under a prefix are
kept as they are if enough of the prefix's rows have them, else generalised into
wildcards of their kind (numbers, dates, hexadecimal, mixed, words; with an
extension or not). So each path ends in a template, and a prefix has a bounded
number of branches. From the last level to the first, branches that agree in all
but one segment are merged unless their labelled purity differs from the others'
by a two-proportion test. A template's purity is smoothed towards its host's, and
that towards the purity of all labels; templates under a threshold are blocked.
Rules, where one fits, come before.

Everything is DataFrame work on built-in functions. Rows are summed before each
shuffle; joins meet small tables, which are broadcast if their checked number of
rows allows it, else joined with hot keys apart. Nothing is held per host.

Defined results: a null address, or one without ``://``, has an empty host and
path, and is allowed unless a rule fits; an empty path is a template of its own;
segments beyond DEPTH are one wildcard; repeated rows count again and get the same
verdict; an empty table gives no rows; other columns pass through, whatever their
names, but one with the name of an output, which is a parameter, is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import MOST_MARKS, lookup, materialize

#: Segments of a path that are read apart; further ones are one wildcard.
DEPTH = 6
#: Rows, and share of a prefix's rows, that a segment needs to be kept.
KEEP_ROWS, KEEP_SHARE = 8, 0.05
#: Branches merge if their purities differ by no more than so many standard errors.
SIGMAS = 1.96
#: Labels that the smoothing counts as, and the purity under which a template is blocked.
WEIGHT, PURE = 5.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = "(?s)^.*?://([^/?#]*)([^?#]*)"
EXTENSION = r"\.[A-Za-z]{1,5}\z"
#: Kinds of segments and their patterns, the first that fits counts; words are what is left.
KINDS = [("n", r"^[0-9]+\z"), ("d", r"^[0-9-]+\z"), ("h", r"^[0-9a-f]{8,}\z"), ("x", "[0-9]")]
_SUMS = ["n", "labelled", "good"]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule (verdict, host, path) that fits, or null; of equally long ones the one with the longer host. Rules are few enough to stand in the plan."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    made = [F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in longest]
    return F.coalesce(*made, F.lit(None).cast("struct<rule:string,verdict:string>"))


def segments(path: Column) -> Column:
    """The path's segments after its first slash; none for an empty path. What is beyond DEPTH is one wildcard."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    first = F.slice(parts, 1, DEPTH)
    return F.when(path == "", F.array().cast("array<string>")).when(F.size(parts) > DEPTH, F.concat(first, F.array(F.lit("{rest}")))).otherwise(first)


def wildcard(segment: Column) -> Column:
    """The kind of a segment."""
    end = F.when(segment.rlike(rf"[^.]{EXTENSION}"), F.lit(".")).otherwise(F.lit(""))
    stem = F.regexp_replace(segment, rf"([^.]){EXTENSION}", "$1")
    kind = F.lit("w")
    for name, pattern in reversed(KINDS):
        kind = F.when(stem.rlike(pattern), name).otherwise(kind)
    return F.when(segment == "{rest}", segment).when(segment == "", "").otherwise(F.concat(F.lit("{"), kind, end, F.lit("}")))


def literal(segment: Column) -> Column:
    """A segment that is kept; braces and stars of its own never look like wildcards."""
    return F.when(segment == "{rest}", segment).otherwise(F.replace(F.replace(segment, F.lit("{"), F.lit("{{")), F.lit("*"), F.lit("{*")))


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of a written table of one row per key, null where there is none."""
    if right.count() <= MOST_MARKS:
        return left.join(F.broadcast(right), keys, "left")
    return lookup(materialize(left, "url-rows"), right, keys, "left")


def step(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows (host, prefix, rest, ...) one level further: the first of the rest moves to the prefix, kept or generalised."""
    named = rows.withColumn("_segment", F.get("rest", F.lit(0)))
    found = attach(named, kept.select("host", "prefix", F.col("segment").alias("_segment"), F.lit(True).alias("_kept")), ["host", "prefix", "_segment"])
    piece = F.when(F.col("_kept"), literal(F.col("_segment"))).otherwise(wildcard(F.col("_segment")))
    further = F.col("_segment").isNotNull()
    moved = {"prefix": F.when(further, F.concat("prefix", F.array(piece))).otherwise(F.col("prefix")), "rest": F.when(further, F.slice("rest", F.lit(2), F.greatest(F.size("rest") - 1, F.lit(0)))).otherwise(F.col("rest"))}
    return found.withColumns(moved).drop("_segment", "_kept")


def template_tree(paths: DataFrame, keep_rows: int = KEEP_ROWS, keep_share: float = KEEP_SHARE) -> tuple[DataFrame, list[DataFrame]]:
    """Templates (host, template, n, labelled, good) of ``paths`` (host, path and these sums), and per level the kept segments (host, prefix, segment)."""
    state = paths.select("host", F.array().cast("array<string>").alias("prefix"), segments(F.col("path")).alias("rest"), *_SUMS)
    kept = []
    while True:
        state = materialize(state.groupBy("host", "prefix", "rest").agg(*[F.sum(c).alias(c) for c in _SUMS]), "url-tree")
        open_ = state.where(F.size("rest") > 0)
        if open_.isEmpty():
            return state.select("host", F.col("prefix").alias("template"), *_SUMS), kept
        many = open_.groupBy("host", "prefix", F.get("rest", F.lit(0)).alias("segment")).agg(F.sum("n").alias("n")).where(F.col("n") >= keep_rows)
        total = open_.groupBy("host", "prefix").agg(F.sum("n").alias("total")).where(F.col("total") >= keep_rows)
        shared = lookup(materialize(many, "url-segments"), materialize(total, "url-prefixes"), ["host", "prefix"])
        kept.append(materialize(shared.where(F.col("n") >= F.lit(keep_share) * F.col("total")).select("host", "prefix", "segment"), "url-kept"))
        state = step(state, kept[-1])


def merged(templates: DataFrame, levels: int, sigmas: float = SIGMAS) -> DataFrame:
    """``templates`` with ``branch``: the template after its similar branches were merged, the last level first.

    A prefix has at most ``1 / keep_share`` kept segments and some wildcards, so
    the windows are small, whatever the number of rows.
    """
    rows = templates.withColumn("branch", F.col("template"))
    for level in range(levels, 0, -1):
        around = F.concat(F.slice("branch", 1, level - 1), F.array(F.lit("*")), F.slice("branch", F.lit(level + 1), F.greatest(F.size("branch") - level, F.lit(0))))
        rows = rows.withColumn("_around", F.when(F.size("branch") >= level, around).otherwise(F.col("branch")))
        own, all_ = Window.partitionBy("host", "branch"), Window.partitionBy("host", "_around")
        rows = rows.withColumns({"_m": F.sum("labelled").over(own), "_g": F.sum("good").over(own), "_first": F.row_number().over(own.orderBy("template")) == 1})
        rows = rows.withColumns({"_all": F.sum("labelled").over(all_), "_pure": F.sum("good").over(all_)})
        rest, p = F.col("_all") - F.col("_m"), F.try_divide("_pure", "_all")
        apart = F.try_divide("_g", "_m") - F.try_divide(F.col("_pure") - F.col("_g"), rest)
        error = p * (1 - p) * (F.try_divide(F.lit(1.0), "_m") + F.try_divide(F.lit(1.0), rest))
        rows = rows.withColumn("_like", F.when((F.col("_m") == 0) | (rest == 0), True).otherwise(apart * apart <= F.lit(sigmas * sigmas) * error))
        together = F.count_if(F.col("_first") & F.col("_like")).over(all_) >= 2
        rows = rows.withColumn("branch", F.when(F.col("_like") & together, F.col("_around")).otherwise(F.col("branch")))
        rows = rows.drop("_around", "_m", "_g", "_first", "_all", "_pure", "_like")
    return rows


def judged(templates: DataFrame, levels: int, weight: float = WEIGHT, pure: float = PURE) -> DataFrame:
    """(host, template, branch, purity, blocked)."""
    rows = materialize(merged(templates, levels), "url-branches")
    whole = rows.agg(F.sum("labelled").alias("m"), F.sum("good").alias("g")).first()  # one row
    prior = (whole["g"] / whole["m"]) if whole["m"] else 1.0
    smooth = lambda good, labelled, to: (good + F.lit(weight) * to) / (labelled + F.lit(weight))
    hosts = rows.groupBy("host").agg(smooth(F.sum("good"), F.sum("labelled"), F.lit(float(prior))).alias("_host"))
    branches = rows.groupBy("host", "branch").agg(F.sum("labelled").alias("_m"), F.sum("good").alias("_g"))
    purity = branches.join(hosts, "host").select("host", "branch", smooth(F.col("_g"), F.col("_m"), F.col("_host")).alias("purity"))
    found = rows.select("host", "template", "branch").join(purity, ["host", "branch"])
    return found.select("host", "template", "branch", "purity", (F.col("purity") < F.lit(pure)).alias("blocked"))


def label_paths(paths: DataFrame, labels: DataFrame, key: Column) -> DataFrame:
    """``paths`` (host, path, n) with ``labelled`` and ``good``: those whose ``key`` has a label (key, good). A label counts once for each path."""
    keyed = materialize(paths.withColumn("key", key), "url-keys")
    few = materialize(labels.where("key IS NOT NULL AND good IS NOT NULL").groupBy("key").agg(F.bool_and("good").alias("_good")), "url-labels")
    found = attach(keyed, few, ["key"])
    return found.select("host", "path", "n", F.col("_good").isNotNull().cast("long").alias("labelled"), F.coalesce(F.col("_good").cast("long"), F.lit(0)).alias("good"))


def with_verdicts(
    df: DataFrame, labels: DataFrame, key_of_path: Column, rules: list[tuple[str, str, str]], url: str = "url", host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict", template: str = "template", purity: str = "purity"
) -> DataFrame:
    """``df`` with each address's host, path, rule, template, its purity, and the verdict. ``labels``: (key, good); ``key_of_path`` is the key of a row with column ``path``."""
    counted = df.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    paths = materialize(label_paths(counted, labels, key_of_path), "url-paths")
    templates, kept = template_tree(paths)
    verdicts = materialize(judged(templates, len(kept)), "url-verdicts")
    state = paths.select("host", "path", F.array().cast("array<string>").alias("prefix"), segments(F.col("path")).alias("rest"))
    found = attach(reduce(step, kept, state), verdicts.select("host", F.col("template").alias("prefix"), "branch", "purity", "blocked"), ["host", "prefix"])
    found = materialize(found.select("host", "path", "branch", "purity", "blocked"), "url-judged")
    rows = df.select(F.struct(*df.columns).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    by_rule = rule_of(F.col("host"), F.col("path"), rules)
    named = {
        host: F.col("host"), path: F.col("path"), rule: by_rule["rule"],
        verdict: F.coalesce(by_rule["verdict"], F.when(F.col("blocked") & (F.col("host") != ""), "block").otherwise("allow")),
        template: F.concat(F.lit("/"), F.array_join("branch", "/")), purity: F.col("purity"),
    }
    kept_columns = [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in named]
    return lookup(materialize(rows, "url-rows"), found, ["host", "path"]).select(*kept_columns, *[v.alias(k) for k, v in named.items()])
