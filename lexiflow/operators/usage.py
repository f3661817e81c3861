"""Usage-log operators over message / event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that mark a plotting request (matched as whole words,
# any case).
PLOT_WORDS = (
    r"plot(s)?|chart(s)?|graph(s)?|draw|visualize|sketch|illustrate|render|depict|map|trace|diagram(s)?|"
    r"scatter(plot)?s?|bar(plot)?s?|hist(ogram)?s?|hist(s)?|pie(chart)?s?|pie(s)?|line(plot)?s?|line(s)?|"
    r"area(s)?|heatmap(s)?|box(plot)?s?|box(es)?|violin(plot)?s?|violin(s)?|bubble(chart)?s?|bubble(s)?|"
    r"density(plot)?s?|density(s)?|hexbin(s)?|error(bar)?s?|error(s)?|stacked|polar|donut(chart)?s?|donut(s)?|"
    r"funnel(s)?|distribution(s)?|dist(plot)?s?|point(s)?|joint(plot)?s?|pair(plot)?s?|categorical|swarm(plot)?s?|"
    r"fit|reg(plot)?s?|lm(plot)?s?|kde(plot)?s?|boxen(plot)?s?|strip(plot)?s?|count(plot)?s?|"
    r"treemap(s)?|sunburst(s)?|waterfall(s)?|step(plot)?s?|ribbon(s)?|contour(f)?s?|contour(s)?|"
    r"mosaic(s)?|matrix|matrices|ridge(s)?|ridgeline(s)?|par(coord)?s?|parallel(s)?|dendrogram(s)?|"
    r"network(s)?|chord(s)?|sankey(s)?|facet(s)?|subplot(s)?|axes|axis|x-?axis|y-?axis|z-?axis|"
    r"color|hue|size|shape|label(s)?|legend(s)?|title(s)?|grid(s)?|background|foreground|font(s)?|"
    r"scale(s)?|range(s)?|tick(s)?|mark(s)?|spine(s)?|border(s)?|strip(s)?|dot(plot)?s?|dot(s)?"
)
# Word boundaries written as explicit classes so Java and RE2 agree.
PLOT_PATTERN = r"(?i)(^|[^\p{L}\p{N}_])(" + PLOT_WORDS + r")($|[^\p{L}\p{N}_])"

QUOTA = 10                 # fixed value: user messages allowed per 24 hours
DAY_MICROS = 86_400_000_000


def message_intent(text: Column) -> Column:
    return (F.when(text.isNull() | (F.regexp_replace(text, r"^\s+|\s+$", "") == ""), F.lit("none"))
             .when(text.rlike(PLOT_PATTERN), F.lit("plot"))
             .otherwise(F.lit("chat")))


def pseudonymise(df: DataFrame, user: str, ts: str, role: Column, domain_suffix: str | None = None) -> DataFrame:
    """SHA-256 of the user id; row key = 12 hex chars - yyyyMMddHHmmss - role
    digit (0 for user messages, 1 otherwise); optional domain flag."""
    h = F.sha2(F.col(user).cast("string"), 256)
    out = df.withColumn("user_hash", h).withColumn(
        "row_key", F.concat(F.substring(h, 1, 12), F.lit("-"), F.date_format(F.col(ts), "yyyyMMddHHmmss"), F.lit("-"),
                            F.when(role == F.lit("user"), F.lit("0")).otherwise(F.lit("1"))))
    if domain_suffix is not None:
        out = out.withColumn("in_domain", F.col(user).cast("string").endswith(domain_suffix))
    return out


def rolling_quota(messages: DataFrame, user: str = "user_id", ts: str = "ts", quota: int = QUOTA) -> DataFrame:
    """Per user message: user messages in the 24 h up to it, and whether the
    quota is reached.  Range frames are evaluated per (user, day) with the
    previous day's rows copied in as context, so a very active user is
    spread over one task per day."""
    m = messages.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    day = F.floor(F.col("_us") / F.lit(DAY_MICROS))
    m = m.withColumn("_ctx", F.explode(F.array(F.struct(day.alias("d"), F.lit(True).alias("own")),
                                               F.struct((day + 1).alias("d"), F.lit(False).alias("own")))))
    m = m.withColumn("_day", F.col("_ctx.d")).withColumn("_own", F.col("_ctx.own")).drop("_ctx")
    w = Window.partitionBy(user, "_day").orderBy("_us").rangeBetween(-DAY_MICROS, 0)
    return (m.withColumn("n_24h", F.count(F.lit(1)).over(w)).filter("_own")
             .withColumn("quota_reached", F.col("n_24h") >= quota).drop("_us", "_day", "_own"))


def prune_thread(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", max_length: int = 20) -> DataFrame:
    """Threads longer than ``max_length`` keep their first user message and
    the last ``max_length - 1`` messages (the first one once).  Per-thread
    figures are aggregates joined back; the rank from the end comes from the
    blocked ordinal, so a huge thread is not one task."""
    from .sequence import dense_rank_in_doc

    per = messages.groupBy(conv).agg(
        F.count(F.lit(1)).alias("_n"),
        F.coalesce(F.min(F.when(F.col("role") == "user", F.col(turn))), F.min(turn)).alias("_first"))
    m = dense_rank_in_doc(messages, [conv], turn, "_ord").join(per, conv)
    keep = ((F.col("_n") <= max_length) | (F.col("_n") - F.col("_ord") <= max_length - 1)
            | (F.col(turn) == F.col("_first")))
    return m.filter(keep).drop("_n", "_first", "_ord")
