"""Prompts as token arrays: layouts, truncation, spans, permutations and padding.

A tokenizer is a column function from text to an array of ids; ``code_points`` is a reversible one for tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The texts around a state, a question and options in each layout.
CHAT_HEAD = "<|turn>user\nState:\n"
CHAT_END = "<turn|>\n<|turn>model\n"
PLAIN_HEAD = "State:\n"
LETTER_END = "\n\nAnswer with the letter of the correct option.<turn|>\n<|turn>model\n"
MIDDLE = " […] "
MODES = ("slot", "letter", "scalar", "span", "clef")
MAX_OPTION_TOKENS, LEAST_STATE, LETTERS = 160, 16, 26


def code_points(text: Column) -> Column:
    """Each character's code point and 10."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.conv(F.hex(F.encode(c, "utf-32")), 16, 10).cast("int") + 10)


def letter_text(state: Column, question: Column, options: Column) -> Column:
    """The lettered prompt as text."""
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")
    return F.concat(F.lit(CHAT_HEAD), F.trim(state), F.lit("\n\nQuestion:\n"), F.trim(question), F.lit("\n\nOptions:\n"), listed, F.lit(LETTER_END))


def truncate_middle(ids: Column, budget: Column, middle: Column) -> Column:
    """ids within a budget: the head, the middle mark, and the tail."""
    keep = F.greatest(budget - F.size(middle), F.lit(2))
    head = F.floor(keep / 2).cast("int")
    tail = (keep - head).cast("int")
    cut = F.concat(F.slice(ids, F.lit(1), head), middle, F.slice(ids, F.size(ids) - tail + 1, tail))
    return F.when(F.size(ids) <= budget, ids).otherwise(cut)


def render(df: DataFrame, mode: str, tok: Callable[[Column], Column] = code_points, max_len: int = 2048, bos: int = 2, marker: int = 3, chat: bool = False, max_option: int = MAX_OPTION_TOKENS) -> DataFrame:
    """df (state, question, kind, options) with status, input_ids, rows (scalar: one for each option), slots, spans and qspan.

    status is ok, too_many_options (letters only) or no_room, when question and options leave under 16 ids for the state.
    """
    if mode not in MODES:
        raise ValueError(mode)
    chat = chat or mode == "letter"
    question, k = F.trim(F.col("question")), F.size("options")
    head = F.concat(F.array(F.lit(bos)), tok(F.lit(CHAT_HEAD if chat else PLAIN_HEAD)))
    none = F.array().cast("array<int>")
    df = df.withColumn("head_", head).withColumn("state_", tok(F.trim(F.col("state")))).withColumn("middle_", tok(F.lit(MIDDLE)))
    end = tok(F.lit(LETTER_END)) if mode == "letter" else tok(F.lit(CHAT_END)) if chat else none
    asked = F.concat(F.lit("\n\nQuestion:\n") if mode == "letter" else F.concat(F.lit("\n\nQuestion ("), F.col("kind"), F.lit("):\n")))
    close = F.lit("\n\nOption:\n" if mode == "scalar" else "\n\nOptions:\n")
    df = df.withColumn("pre_", tok(asked)).withColumn("q_", tok(question)).withColumn("post_", tok(close)).withColumn("end_", end)
    df = df.withColumn("mid_", F.concat("pre_", "q_", "post_"))
    newline = lambda i: F.when(F.lit(not chat) | (i < k - 1), "\n").otherwise("")
    if mode == "scalar":
        body = F.transform("options", lambda o: F.slice(tok(o), 1, max_option))
    elif mode == "slot":
        body = F.transform("options", lambda o, i: F.concat(F.array(F.lit(marker)), F.slice(tok(F.concat(F.lit(" "), o, newline(i))), 1, max_option)))
    elif mode == "letter":
        body = F.transform("options", lambda o, i: F.slice(tok(F.concat(F.char(i + 65), F.lit(". "), o, newline(i))), 1, max_option))
    else:
        body = F.transform("options", lambda o, i: F.concat(F.slice(tok(o), 1, max_option), tok(newline(i))))
    df = df.withColumn("bodies_", body).withColumn("texts_", F.transform("options", lambda o: F.least(F.size(tok(o)), F.lit(max_option))))
    lengths = F.transform("bodies_", lambda b: F.size(b))
    most = F.array_max(lengths) if mode == "scalar" else F.aggregate(lengths, F.lit(0), lambda a, b: a + b)
    df = df.withColumn("budget_", F.lit(max_len) - F.size("head_") - F.size("mid_") - F.size("end_") - most)
    status = F.when(F.lit(mode == "letter") & (k > LETTERS), "too_many_options").when(F.col("budget_") < LEAST_STATE, "no_room").otherwise("ok")
    df = df.withColumn("status", status).withColumn("cut_", truncate_middle(F.col("state_"), F.col("budget_"), F.col("middle_")))
    ok = F.col("status") == "ok"
    front = F.size("head_") + F.size("cut_") + F.size("mid_")
    starts = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.aggregate(F.slice("bodies_", F.lit(1), i), front, lambda a, b: a + F.size(b)))
    df = df.withColumn("starts_", starts)
    rows = F.transform("bodies_", lambda b: F.concat("head_", "cut_", "mid_", b, "end_"))
    whole = F.concat("head_", "cut_", "mid_", F.flatten("bodies_"), "end_")
    if mode == "scalar":
        longest = F.array_max(F.transform("bodies_", lambda b: F.size(b)))
        df = df.withColumn("rows", F.when(ok, rows)).withColumn("input_ids", F.when(ok, F.get(F.filter("rows", lambda r: F.size(r) == F.size("head_") + F.size("cut_") + F.size("mid_") + F.size("end_") + longest), F.lit(0))))
    else:
        df = df.withColumn("rows", F.lit(None).cast("array<array<int>>")).withColumn("input_ids", F.when(ok, whole))
    q_at = F.size("head_") + F.size("cut_") + F.size("pre_")
    df = df.withColumn("slots", F.when(ok & F.lit(mode == "slot"), F.col("starts_")))
    df = df.withColumn("spans", F.when(ok & F.lit(mode in ("span", "clef")), F.zip_with("starts_", "texts_", lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))))
    df = df.withColumn("qspan", F.when(ok & F.lit(mode == "clef"), F.struct(q_at.alias("start"), (q_at + F.size("q_")).alias("end"))))
    return df.drop("head_", "state_", "middle_", "pre_", "q_", "post_", "end_", "mid_", "bodies_", "texts_", "budget_", "cut_", "starts_")


def permutation(identity: Column, kind: Column, options: Column, seed: int = 0) -> Column:
    """An order of options by hash; ordered options are kept or reversed."""
    n = F.size(options)
    h = lambda i: F.sha2(F.concat_ws(":", F.lit(str(seed)), identity, i.cast("string")), 256)
    plain = F.sequence(F.lit(0), n - 1)
    mixed = F.transform(F.array_sort(F.transform(plain, lambda i: F.struct(h(i).alias("h"), i.alias("i")))), lambda s: s["i"])
    flip = F.substring(h(F.lit(-1)), 1, 1).isin(*"01234567")
    return F.when(kind == "score", F.when(flip, F.reverse(plain)).otherwise(plain)).otherwise(mixed)


def cap_options(df: DataFrame, most: int, seed: int = 0, identity: str = "id") -> DataFrame:
    """df with options, target and option_values cut to at most ``most``: all with mass, and others by hash, in their order. too_many_targets marks rows that have more with mass."""
    h = lambda i: F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(identity), i.cast("string")), 256)
    zipped = F.transform(F.arrays_zip("options", "target"), lambda x, i: F.struct((x["target"] <= 0).alias("z"), F.when(x["target"] > 0, "").otherwise(h(i)).alias("h"), i.alias("i")))
    df = df.withColumn("massed_", F.size(F.filter("target", lambda t: t > 0))).withColumn("order_", zipped)
    df = df.withColumn("keep_", F.when(F.size("options") <= most, F.sequence(F.lit(0), F.size("options") - 1)).otherwise(F.array_sort(F.transform(F.slice(F.array_sort("order_"), 1, most), lambda s: s["i"]))))
    df = df.withColumn("too_many_targets", (F.col("massed_") > most) & (F.size("options") > most))
    for c in ("options", "target", *(["option_values"] if "option_values" in df.columns else [])):
        df = df.withColumn(c, F.when(F.col(c).isNotNull(), F.transform("keep_", lambda i: F.get(F.col(c), i))))  # noqa: B023
    return df.drop("massed_", "order_", "keep_")


def sample_negatives(df: DataFrame, most: int, seed: int = 0, identity: str = "id") -> DataFrame:
    """cap_options with offset: ln(options without mass / those of them kept), 0 where nothing was cut."""
    zero = F.size(F.filter("target", lambda t: t <= 0))
    df = df.withColumn("before_", zero)
    df = cap_options(df, most, seed, identity)
    return df.withColumn("offset", F.when((F.col("before_") > zero) & (zero > 0), F.ln(F.col("before_") / zero)).otherwise(0.0)).drop("before_")


def pad(array: Column, length: Column, fill: int = 0) -> Column:
    return F.concat(array, F.array_repeat(F.lit(fill), F.greatest(length - F.size(array), F.lit(0)).cast("int")))


def pack(df: DataFrame, batch: str, ids: str = "input_ids", fill: int = 0) -> DataFrame:
    """A row for each batch: input_ids right-padded to its longest, and the valid lengths."""
    grouped = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("place", F.col(ids).alias("x")))).alias("r")).withColumn("most", F.array_max(F.transform("r", lambda s: F.size(s["x"]))))
    return grouped.select(batch, F.transform("r", lambda s: pad(s["x"], F.col("most"), fill)).alias("input_ids"), F.transform("r", lambda s: F.size(s["x"])).alias("lengths"))
