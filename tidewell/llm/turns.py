"""Speech transcripts and dialogue rows into clean, ordered speaker turns.

Segments are put on the time line by a sweep over their start times (a mark in the text stands in
for a missing time, arrival order breaks ties), rows without speech are left out, the words a
rolling caption repeats are cut by suffix-prefix overlap with the row before, and a turn ends
where the speaker changes or, where ``pause_factor`` is given, at a pause longer than that many
times the call's own median pause.

Everything runs per conversation: rows of one conversation meet in one task, and a conversation is
bounded by the length of a call; a seat or feed that holds a large share of the rows is not a key.

Defined results: null text, role or voice count as not given; a text of fillers, sound notes or
marks only is no speech; a conversation without speech gives no turn; repeated rows count once;
a row whose role nothing tells takes the role of the row before it (of the row after it for the
first).  Extra columns are ignored.  Texts of any length are processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATOR, CITIZEN = "operator", "citizen"
# How roles are written.
ROLE_WORDS = {
    OPERATOR: ("operator", "agent", "坐席", "座席", "客服", "接线员", "话务员"),
    CITIZEN: ("citizen", "caller", "customer", "市民", "群众", "来电人", "客户"),
}
# Words without content, and what sound notes in round brackets say.
FILLERS = "嗯+|啊+|呃+|唔+|诶+|哦+|额+|唉+|这个这个|那个|就是说|怎么说呢"
NOTES = "咳嗽|叹气|通话中断|笑声?|噪音|电流声|键盘声|音乐|掌声|静音\\d*秒?|哭声?|noise|music|laughter|cough"

_OPEN, _CLOSE = r"[\[［【(（]", r"[\]］】)）]"
_MARK = rf"(?:{_OPEN}\s*(?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}(?:\.\d+)?\s*{_CLOSE}|(?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}(?=\s)|\d+分\d+秒)"
_WORDS = "|".join(w for ws in ROLE_WORDS.values() for w in ws)
_LABEL = rf"(?i)^\s*(?:{_OPEN}\s*({_WORDS})\d*号?\s*{_CLOSE}\s*[:：]?|({_WORDS})\d*号?\s*[:：])\s*"
_NOTE = rf"(?i)\[[^\[\]]*\]|［[^［］]*］|【[^【】]*】|<[^<>]*>|\{{[^{{}}]*\}}|\*[^*]*\*|♪+|[(（]\s*(?:{NOTES})\s*[)）]"
_FILL = rf"(?:(?<=^)|(?<=[，。！？、,!?…\s]))(?:{FILLERS})(?=[，。！？、,!?…\s]|$)[，、,…]?"
# what a text must hold or begin with for these patterns to find anything
_STARTS_MARK, _STARTS_LABEL = r"^[\[［【(（\d]", r"^\s*[\[［【(（]|^[^:：]{1,16}[:：]"
_HAS_NOTE, _HAS_FILLER = r"[\[［【<{*♪(（]", "[嗯啊呃唔诶哦额唉]|这个这个|那个|就是说|怎么说呢"


def role_of(c: Column) -> Column:
    """operator, citizen or null."""
    w = F.lower(F.trim(c))
    return F.when(w.rlike("^(?:" + "|".join(ROLE_WORDS[OPERATOR]) + r")\d*号?$"), OPERATOR).when(w.rlike("^(?:" + "|".join(ROLE_WORDS[CITIZEN]) + r")\d*号?$"), CITIZEN)


def _stage(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns computed once: a generator keeps their expressions from being copied into every use."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def split_marks(df: DataFrame, text: str) -> DataFrame:
    """Adds _tw_seconds of a leading time mark, _tw_label (role of a leading label) and _tw_body, the rest of the text.

    Patterns are tried only on texts that begin like one, which most don't.
    """
    b, m, c = F.col("_tw_b"), F.col("_tw_mark"), F.col("_tw_c")
    df = _stage(df, F.btrim(F.col(text), F.lit(" \t\n\r\f\u000b")).alias("_tw_b"))
    df = _stage(df, F.when(b.rlike(_STARTS_MARK), F.regexp_extract(b, rf"^{_MARK}", 0)).otherwise("").alias("_tw_mark"))
    t = F.regexp_extract_all(m, F.lit(r"(\d+)"), 1)
    part = lambda i: F.get(t, F.lit(i)).try_cast("int")
    seconds = F.when(m != "", F.when(F.size(t) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(t) == 2, part(0) * 60 + part(1))).cast("double")
    df = _stage(df, seconds.alias("_tw_seconds"), F.when(m != "", F.regexp_replace(b, rf"^(?:{_MARK}\s*)+", "")).otherwise(b).alias("_tw_c"))
    df = _stage(df, F.when(c.rlike(_STARTS_LABEL), F.coalesce(F.nullif(F.regexp_extract(c, _LABEL, 1), F.lit("")), F.nullif(F.regexp_extract(c, _LABEL, 2), F.lit("")))).alias("_tw_l"))
    rest = F.when(F.col("_tw_l").isNotNull(), F.regexp_replace(c, _LABEL, "")).otherwise(c)
    df = _stage(df, role_of(F.col("_tw_l")).alias("_tw_label"), rest.alias("_tw_r"))
    r = F.col("_tw_r")
    df = df.withColumn("_tw_body", F.when(r.rlike(_STARTS_MARK), F.regexp_replace(r, rf"^(?:{_MARK}\s*)+", "")).otherwise(r))
    return df.drop("_tw_b", "_tw_mark", "_tw_c", "_tw_l", "_tw_r")


def clean_wording(df: DataFrame, body: str) -> DataFrame:
    """Adds _tw_clean: the text without sound notes and fillers."""
    x, y = F.col(body), F.col("_tw_x")
    df = _stage(df, F.when(x.rlike(_HAS_NOTE), F.regexp_replace(x, _NOTE, " ")).otherwise(x).alias("_tw_x"))
    for _ in range(2):  # chains go at once; a filler may come to stand at the beginning
        df = _stage(df.withColumnRenamed("_tw_x", "_tw_y"), F.when(F.col("_tw_y").rlike(_HAS_FILLER), F.regexp_replace("_tw_y", _FILL, "")).otherwise(F.col("_tw_y")).alias("_tw_x")).drop("_tw_y")
    spaced = F.when(y.rlike(r"\s\s|[^ \S]"), F.regexp_replace(y, r"\s+", " ")).otherwise(y)
    lead = F.regexp_replace(spaced, r"^[，。、,…\s]+", "")
    return df.withColumn("_tw_clean", F.trim(lead)).drop("_tw_x")


def has_speech(clean: Column) -> Column:
    return F.coalesce(clean.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def overlap(prev: Column, cur: Column, least: int = 6) -> Column:
    """Length of the longest prefix of cur, of at least ``least`` code points, that prev ends with; 0 without one.

    The few rows whose first characters stand in the row before are looked at, every place of those.
    """
    may = (F.length(cur) >= least) & F.contains(prev, F.substring(cur, 1, least))
    starts = F.sequence(F.greatest(F.lit(1), F.length(prev) - F.length(cur) + 1), F.length(prev) - least + 1)
    first = F.array_min(F.filter(starts, lambda i: F.startswith(cur, F.substr(prev, i))))
    return F.coalesce(F.when(may, F.length(prev) - first + 1), F.lit(0))


def speech_rows(
    df: DataFrame,
    conv: str,
    idx: str,
    text: str = "text",
    role: str = "role",
    voice: str | None = None,
    speaker: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """conv_id, idx, start, end, role, clean: the rows with speech, each with its role.

    voice: an id whose number names the speaker within the conversation; where given it decides, by the
    role that most of its rows with a known role give.
    """
    cols = [F.col(conv).alias("conv_id"), F.col(idx).alias("idx"), F.col(text).alias("_tw_text"), F.col(role).alias("_tw_role")]
    cols += [F.col(start).cast("double").alias("_tw_start") if start else F.lit(None).cast("double").alias("_tw_start")]
    cols += [F.col(end).cast("double").alias("_tw_end") if end else F.lit(None).cast("double").alias("_tw_end")]
    cols += [F.regexp_extract(F.col(voice), r"(\d+)\D*$", 1).alias("_tw_voice") if voice else F.lit("").alias("_tw_voice")]
    cols += [F.col(speaker).alias("_tw_speaker") if speaker else F.lit(None).cast("string").alias("_tw_speaker")]
    rows = df.select(*cols).repartition("conv_id")  # the one shuffle: everything after it is keyed by conv_id
    rows = rows.dropDuplicates(["conv_id", "idx"])
    rows = clean_wording(split_marks(rows, "_tw_text"), "_tw_body")
    rows = rows.select(
        "conv_id", "idx", "_tw_end", "_tw_clean",
        F.coalesce("_tw_start", "_tw_seconds").alias("_tw_at"),
        F.coalesce(role_of(F.col("_tw_role")), "_tw_label", role_of(F.col("_tw_speaker"))).alias("_tw_known"),
        F.when(F.col("_tw_voice") != "", F.regexp_replace("_tw_voice", "^0+(?=.)", "")).alias("_tw_v"),
    )
    by_voice = Window.partitionBy("conv_id", "_tw_v")
    of = lambda r: F.count_if(F.col("_tw_known") == r).over(by_voice)
    rows = rows.withColumn("_tw_lead", of(OPERATOR) - of(CITIZEN))
    voted = F.when(F.col("_tw_v").isNotNull(), F.when(F.col("_tw_lead") > 0, OPERATOR).when(F.col("_tw_lead") < 0, CITIZEN))
    rows = rows.withColumn("_tw_vote", voted)
    conv_w = Window.partitionBy("conv_id")
    # of two voices, one may be known only by the other
    other = F.when(F.col("_tw_v").isNotNull() & F.col("_tw_vote").isNull() & (F.size(F.collect_set("_tw_v").over(conv_w)) == 2), F.collect_set("_tw_vote").over(conv_w))
    rows = rows.withColumn("_tw_other", F.when(F.size(other) == 1, F.when(other[0] == OPERATOR, CITIZEN).otherwise(OPERATOR)))
    rows = rows.filter(has_speech(F.col("_tw_clean")))
    order = Window.partitionBy("conv_id").orderBy(F.col("_tw_at").asc_nulls_last(), "idx")
    got = F.coalesce("_tw_vote", "_tw_other", "_tw_known")
    rows = rows.withColumn("_tw_got", got)
    near = F.coalesce(
        "_tw_got",
        F.last("_tw_got", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        F.first("_tw_got", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)),
        F.lit(OPERATOR),
    )
    return rows.select("conv_id", "idx", F.col("_tw_at").alias("start"), F.col("_tw_end").alias("end"), near.alias("role"), F.col("_tw_clean").alias("clean"), F.row_number().over(order).alias("pos"))


def turns(rows: DataFrame, pause_factor: float | None = None) -> DataFrame:
    """conv_id, turn_no, role, first_idx, start, end, n_rows, text, from the rows of ``speech_rows``."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    prev = F.lag("clean").over(order)
    rows = rows.withColumn("_tw_prev", prev).withColumnRenamed("clean", "_tw_clean")
    rows = _stage(rows, overlap(F.col("_tw_prev"), F.col("_tw_clean")).alias("_tw_cut"))
    rows = rows.withColumn("_tw_rest", F.when(F.col("_tw_cut") > 0, F.substr("_tw_clean", F.col("_tw_cut") + 1)).otherwise(F.col("_tw_clean")))
    new = F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True))
    if pause_factor is not None:
        rows = rows.withColumn("_tw_gap", F.col("start") - F.lag("end").over(order))
        usual = F.median(F.when(F.col("_tw_gap") > 0, F.col("_tw_gap"))).over(Window.partitionBy("conv_id"))
        new = new | F.coalesce(F.col("_tw_gap") > pause_factor * usual, F.lit(False))
    rows = rows.withColumn("_tw_new", new.cast("int"))
    rows = rows.withColumn("turn_no", F.sum("_tw_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_tw_rest"))), lambda x: x["_tw_rest"]), " ")
    return rows.groupBy("conv_id", "turn_no").agg(
        F.first("role").alias("role"),
        F.min_by("idx", "pos").cast("int").alias("first_idx"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.count("*").alias("n_rows"),
        F.trim(F.regexp_replace(joined, " +", " ")).alias("text"),
    )

