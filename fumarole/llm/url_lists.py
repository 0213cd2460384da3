"""URL filters by a temporal list join, with DataFrame functions only.

List entries are dated events: a rule is added to a list or removed from it. They become validity
intervals, which of one rule of one list do not overlap. A capture is judged by the entries
active when it was fetched: its URL yields lookup keys (every parent domain, every path prefix
as long as the longest rule), the join matches key and month and then the exact times, and the
most specific active entry decides: path before domain, longer before shorter, allow before block.

Verdicts are worked out once for each distinct (URL, time). A host with a third of all captures
is spread over months and salts, on which the entries are repeated; open intervals end with the
last capture, so an entry has at most one row for each month that has captures.

Defined cases: a null URL, one without a host, or one whose host is longer than a DNS name
(253 characters) matches no rule; without a fetch time no entry is active; events of one rule at
one time count once, and a removal then wins; a removal without an earlier addition does nothing;
entries with a null rule or time, or an unknown kind, action or event, are ignored; repeated
captures are judged alike; empty tables give empty or unfiltered results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Copies of an entry that share the captures of one key and month.
SALTS = 8
#: Microseconds of one time cell.
CELL = 30 * 24 * 3600 * 1_000_000
MAX_HOST = 253

URL = r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and closing dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, URL, 1)), r"\.$", "")


def segments_of(url: Column) -> Column:
    """The path's segments that are not empty."""
    return F.filter(F.split(F.regexp_extract(url, URL, 2), "/"), lambda s: s != "")


def rule_key(kind: Column, rule: Column) -> Column:
    """The lookup key of a rule: a domain, or a host with the first segments of a path."""
    host, path = host_of(rule), F.array_join(segments_of(rule), "/")
    return F.when(kind == "domain", F.concat(F.lit("d:"), host)).when(
        kind == "prefix", F.concat(F.lit("p:"), host, F.lit("/"), path)
    )


def keys_of(url: Column, most: int) -> Column:
    """The lookup keys of a URL, with path prefixes of up to ``most`` segments."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    segments = segments_of(url)
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments), F.lit(most))),
        lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")),
    )
    valid = (host != "") & (F.char_length(host) <= MAX_HOST)
    return F.when(valid, F.concat(domains, prefixes)).otherwise(F.array().cast("array<string>"))


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def intervals(
    entries: DataFrame,
    name: str = "list",
    action: str = "action",
    kind: str = "kind",
    rule: str = "rule",
    event: str = "event",
    at: str = "at",
) -> DataFrame:
    """(list, action, kind, key, since, until) of every stretch in which a rule was listed;
    ``until`` is null while it still is."""
    rows = entries.select(
        F.col(name).alias("list"),
        F.col(action).alias("action"),
        F.col(kind).alias("kind"),
        rule_key(F.col(kind), F.col(rule)).alias("key"),
        F.col(event).alias("event"),
        micros(F.col(at)).alias("since"),
    ).where("key is not null and since is not null")
    rows = rows.where(F.col("action").isin("allow", "block") & F.col("event").isin("add", "remove"))
    same = ["list", "action", "kind", "key"]
    events = rows.groupBy(*same, "since").agg(F.max("event").alias("event"))
    until = F.lead("since").over(Window.partitionBy(*same).orderBy("since"))
    return events.withColumn("until", until).where("event = 'add'").drop("event")


def judge(
    captures: DataFrame,
    entries: DataFrame,
    url: str = "url",
    fetched: str = "fetched",
    key: str = "page_id",
    **names: str,
) -> DataFrame:
    """``captures`` with ``n_active`` (entries that matched), the deciding ``rule`` and ``action``
    (null if none) and ``kept``. Columns of these names are replaced.

    ``names`` gives the entries' columns, as for ``intervals``; ``key`` only spreads rows.
    """
    added = ["n_active", "rule", "action", "kept"]
    taken = [c for c in captures.columns if c not in added or c in (url, fetched)]
    inner = [f"c{i}" for i in range(len(taken))]
    rows = captures.select(*[captures[c].alias(i) for c, i in zip(taken, inner)], captures[key].alias("k"))
    rows = rows.withColumn("url", F.col(inner[taken.index(url)]))
    rows = rows.withColumn("time", micros(F.col(inner[taken.index(fetched)])))

    listed = intervals(entries, **names)
    asked = rows.where("url is not null and time is not null").select("url", "time").distinct()
    low, high = rows.agg(F.min("time"), F.max("time")).first()
    low, high = F.lit(low or 0), F.lit(high or 0)
    size = F.size(F.split(F.when(F.col("kind") == "prefix", F.col("key")), "/")) - 1
    most = listed.agg(F.max(size).alias("m")).first()["m"] or 0

    cells = F.sequence(
        F.floor(F.greatest(F.col("since"), low) / CELL),
        F.floor(F.least(F.coalesce(F.col("until") - 1, high), high) / CELL),
    )
    ends_later = F.col("until").isNull() | (F.col("until") > low)
    active = listed.where((F.col("since") <= high) & ends_later)
    active = active.withColumn("cell", F.explode(cells))
    active = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("url", "time"), F.lit(SALTS)).cast("int")
    looks = asked.withColumns({"cell": F.floor(F.col("time") / CELL), "salt": salt})
    looks = looks.withColumn("key", F.explode(keys_of(F.col("url"), most)))
    found = looks.join(active, ["key", "cell", "salt"]).where(
        (F.col("since") <= F.col("time")) & (F.col("until").isNull() | (F.col("time") < F.col("until")))
    )
    order = F.struct(
        (F.col("kind") == "prefix").alias("path"),
        F.char_length("key").alias("length"),
        (F.col("action") == "allow").alias("allow"),
        F.substring("key", 3, 1 << 30).alias("rule"),
        "action",
    )
    verdicts = found.groupBy("url", "time").agg(F.count("*").alias("n_active"), F.max(order).alias("best"))
    verdicts = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
    judged = rows.join(verdicts, ["url", "time", "salt"], "left")
    return judged.select(
        *inner,
        F.coalesce("n_active", F.lit(0)).alias("n_active"),
        F.col("best.rule").alias("rule"),
        F.col("best.action").alias("action"),
        F.coalesce(F.col("best.action") != "block", F.lit(True)).alias("kept"),
    ).toDF(*taken, *added)


def dated_entries(pages: DataFrame) -> DataFrame:
    """List events derived from the pages' hosts: suspicious names and every tenth other domain
    are blocked for some time and again later; one section of each is allowed meanwhile."""
    host = host_of(F.col("url"))
    labels = F.split(host, r"\.")
    hosts = pages.select(
        "page_id",
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), ".").alias("domain"),
    )
    first = hosts.groupBy("domain").agg(F.min("page_id").alias("n"))
    odd = F.col("domain").rlike("ads|spam|casino|pills|bets|adult")
    first = first.where(odd | (F.col("n") % 10 == 0))

    def event(name: str, action: str, kind: str, rule: Column, what: str, day: Column) -> Column:
        return F.struct(
            F.lit(name).alias("list"),
            F.lit(action).alias("action"),
            F.lit(kind).alias("kind"),
            rule.alias("rule"),
            F.lit(what).alias("event"),
            day_time(day).alias("at"),
        )

    domain, section = F.col("domain"), F.concat("domain", F.lit("/en"))
    start = F.col("n") * 31 % 120
    events = F.array(
        event("hosts", "block", "domain", domain, "add", start),
        event("hosts", "block", "domain", domain, "remove", start + 60),
        event("hosts", "block", "domain", domain, "add", start + 150),
        event("sections", "allow", "prefix", section, "add", F.col("n") * 17 % 90),
        event("sections", "allow", "prefix", section, "remove", F.col("n") * 17 % 90 + 200),
    )
    return first.select(F.inline(events))


def day_time(day: Column) -> Column:
    """Midnight (UTC) of a day of 2024."""
    return F.timestamp_seconds(F.lit(1_704_067_200) + day * 86_400)


def op3_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", day_time(F.col("page_id") * 7919 % 366))
    judged = judge(captures, dated_entries(pages))
    return judged.select(
        "page_id",
        "url",
        F.unix_seconds("fetched").alias("fetched_epoch"),
        "n_active",
        "rule",
        "action",
        "kept",
    )
