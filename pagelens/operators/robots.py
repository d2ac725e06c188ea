"""Robots files as tables: groups, rules and what they allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls as U

#: Crawlers that gather training data, answer engines and assistants.
TRAINING_BOTS = ("GPTBot", "ClaudeBot", "CCBot", "Google-Extended")
SEARCH_BOTS = ("OAI-SearchBot", "Claude-SearchBot", "PerplexityBot")


def robots_lines(sites: DataFrame) -> DataFrame:
    """(crawl_id, pos, field, value): the meaningful lines of sites(crawl_id, robots_txt), comments off, fields in lower case."""
    lines = sites.select("crawl_id", F.posexplode(F.split("robots_txt", r"\r?\n")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    parts = lines.select("crawl_id", "pos", F.lower(F.trim(F.split(bare, ":", 2)[0])).alias("field"), F.trim(F.get(F.split(bare, ":", 2), 1)).alias("value"))
    return parts.where("field <> '' and value is not null")


def pattern_regex(pattern: Column) -> Column:
    """A rule's path pattern as a regular expression: * is anything, a closing $ the end, the rest literal."""
    quoted = F.regexp_replace(pattern, r"([.^$|?+(){}\[\]\\])", r"\\$1")
    anything = F.replace(quoted, F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), F.regexp_replace(anything, r"\\\$$", r"\$"))


def robots_rules(sites: DataFrame) -> DataFrame:
    """(crawl_id, agent, allow, pattern, regex, length): each rule for each agent of its group.

    A file's lines are folded inside its row: an agent line after a rule starts a new group. No window
    over many files, and a file of any length stays one row of its site.
    """
    lines = F.filter(
        F.transform(
            F.split("robots_txt", r"\r?\n"),
            lambda x: F.struct(
                F.lower(F.trim(F.split(F.regexp_replace(x, "#.*$", ""), ":", 2)[0])).alias("field"),
                F.trim(F.get(F.split(F.regexp_replace(x, "#.*$", ""), ":", 2), 1)).alias("value"),
            ),
        ),
        lambda s: s["field"].isin("user-agent", "allow", "disallow") & s["value"].isNotNull(),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("agents"), F.lit(False).alias("in_rules"), F.array().cast("array<struct<agent:string,allow:boolean,pattern:string>>").alias("rules")
    )

    def step(acc: Column, line: Column) -> Column:
        agent = F.array(F.lower(line["value"]))
        is_agent = line["field"] == "user-agent"
        rules = F.transform(acc["agents"], lambda a: F.struct(a.alias("agent"), (line["field"] == "allow").alias("allow"), line["value"].alias("pattern")))
        return F.struct(
            F.when(is_agent & acc["in_rules"], agent).when(is_agent, F.concat(acc["agents"], agent)).otherwise(acc["agents"]).alias("agents"),
            (~is_agent).alias("in_rules"),
            F.when(is_agent, acc["rules"]).otherwise(F.concat(acc["rules"], rules)).alias("rules"),
        )

    rules = sites.where("robots_txt is not null").select("crawl_id", F.inline(F.aggregate(lines, start, step, lambda acc: acc["rules"])))
    return rules.where("pattern <> ''").select(
        "crawl_id", "agent", "allow", "pattern", pattern_regex(F.col("pattern")).alias("regex"), F.length("pattern").alias("length")
    )


def literal_prefix(pattern: Column) -> Column:
    """What an address must begin with to fit a rule's path pattern: the pattern up to its first *, without a closing $."""
    return F.regexp_replace(F.split(pattern, r"\*")[0], r"\$$", "")


def matching_rules(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(crawl_id, url, agent, allow, length): the rules of each request's group that fit its address, one row for each fit.

    Rules are joined on the text that an address must begin with, so an address meets the few rules of its own
    folder and not all of its file: it goes under its own beginnings of those lengths that the group's rules have, and only what
    fits so far is held against the whole pattern. A hot site is spread by these beginnings, and its rules without any,
    such as /*.pdf, meet its addresses in a join that Spark splits.
    """
    lead = rules.withColumns({"_group": F.col("agent"), "_lead": literal_prefix(F.col("pattern"))}).drop("agent").distinct()
    groups = lead.groupBy("crawl_id", "_group").agg(F.collect_set(F.length("_lead")).alias("_lengths"))
    asked = requests.select("crawl_id", "url", "agent").distinct().withColumn("_agent", F.lower("agent"))
    own = groups.select("crawl_id", F.col("_group").alias("_agent"), F.col("_lengths").alias("_own"))
    every = groups.where("_group = '*'").select("crawl_id", F.col("_lengths").alias("_every"))
    asked = asked.join(own, ["crawl_id", "_agent"], "left").join(every, "crawl_id", "left")
    path, query = U.path(F.col("url")), U.query(F.col("url"))
    target = F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    asked = asked.select("crawl_id", "url", "agent", F.when(F.col("_own").isNotNull(), F.col("_agent")).otherwise("*").alias("_group"), F.coalesce("_own", "_every").alias("_lengths"), target.alias("_target"))
    cut = asked.withColumn("_length", F.explode("_lengths")).where(F.length("_target") >= F.col("_length")).drop("_lengths")
    keyed = cut.withColumn("_lead", F.substring("_target", 1, F.col("_length")))
    met = keyed.join(lead.select("crawl_id", "_group", "_lead", "allow", "regex", "length"), ["crawl_id", "_group", "_lead"])
    return met.where(F.expr("_target rlike regex")).select("crawl_id", "url", "agent", "allow", "length")


def robots_allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """requests(crawl_id, url, agent) with allowed: the longest matching rule of the agent's group decides, allow on a tie; without one all is allowed.

    An agent's own group counts if the file has one, else that of *. Each request keeps the best of its matching_rules by a
    pre-aggregated maximum.
    """
    best = matching_rules(requests, rules).groupBy("crawl_id", "url", "agent").agg(F.max_by("allow", F.struct("length", "allow")).alias("allowed"))
    return requests.join(best, ["crawl_id", "url", "agent"], "left").fillna(True, ["allowed"])


def bot_access(sites: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(crawl_id, bot, robots_allowed, live_ok) of the listed crawlers for each site's start page; live(crawl_id, bot, live_ok) is measured outside."""
    bots = F.array(*[F.lit(b) for b in (*TRAINING_BOTS, *SEARCH_BOTS)])
    asked = sites.select("crawl_id", F.coalesce("base_url", F.concat(F.lit("https://"), "crawl_id", F.lit("/"))).alias("url"), F.explode(bots).alias("agent"))
    allowed = robots_allowed(asked, robots_rules(sites)).select("crawl_id", F.col("agent").alias("bot"), F.col("allowed").alias("robots_allowed"))
    if live is None:
        return allowed.withColumn("live_ok", F.lit(None).cast("boolean"))
    return allowed.join(live, ["crawl_id", "bot"], "left")
