"""Dataset formats: detection from the schema, chat conversion, preference pairs and prompts, type conversion, templates.

Messages are ARRAY<STRUCT<role, content>>. Formats are decided from the analysed schema, not from a first row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHAT_COLUMNS = ("prompt", "chosen", "rejected", "completion", "messages", "conversations")


def _fields(df: DataFrame, column: str) -> set[str]:
    kind = df.schema[column].dataType if column in df.columns else None
    return set(kind.elementType.fieldNames()) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else set()


def is_conversational(df: DataFrame) -> bool:
    """Whether the first supported column holds messages."""
    return any("role" in _fields(df, c) for c in ("prompt", "chosen", "rejected", "completion", "messages"))


def is_from_value(df: DataFrame) -> bool:
    return {"from", "value"} <= _fields(df, "conversations")


def to_chatml(df: DataFrame) -> DataFrame:
    """from/value messages as role/content, the column conversations as messages; other data as it is."""
    for c in CHAT_COLUMNS:
        if {"from", "value"} <= _fields(df, c):
            df = df.withColumn(c, F.transform(c, lambda m: F.struct(m["from"].alias("role"), m["value"].alias("content"))))
    return df.withColumnRenamed("conversations", "messages") if "conversations" in df.columns else df


def unpair(df: DataFrame, batch: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Two rows a pair: the chosen completion with label true, the rejected with false. Order: batch, label falling, ordinal."""
    shared = [c for c in ("prompt", batch, ordinal) if c and c in df.columns]
    both = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    return df.select(*shared, F.inline(both))


def maybe_unpair(df: DataFrame, **names) -> DataFrame:
    return unpair(df, **names) if {"chosen", "rejected"} <= set(df.columns) else df


def shared_messages(a: str, b: str) -> str:
    """SQL: how many leading messages two arrays share."""
    n = f"least(size({a}), size({b}))"
    return f"coalesce(try_element_at(filter(transform(sequence(0, greatest({n} - 1, 0)), i -> if(i < {n} and {a}[i] = {b}[i], null, i)), i -> i is not null), 1), {n})"


def extract_prompt(df: DataFrame, compat: bool = False) -> DataFrame:
    """Prompt, chosen and rejected from an implicit-prompt pair: what both begin with.

    Strings split at the first differing letter, one letter earlier if the one before it is a space, so that the space
    opens the completions. Equal up to the shorter side: the last shared element stays in the completions.
    ``compat`` keeps the reference's wrap-around at position 0: the test looks at the last element of the chosen side.
    """
    if _fields(df, "chosen"):
        df = df.withColumn("_n", F.expr(shared_messages("chosen", "rejected")))
        last = F.least(F.size("chosen"), F.size("rejected"))
        cut = F.when(F.col("_n") == last, last - 1).otherwise(F.col("_n"))
        df = df.withColumn("_n", F.greatest(cut, F.lit(0)))
        tail = lambda c: F.slice(c, F.col("_n") + 1, F.greatest(F.size(c) - F.col("_n"), F.lit(0)))
        out = df.withColumns({"prompt": F.slice("chosen", F.lit(1), F.col("_n")), "chosen": tail("chosen"), "rejected": tail("rejected")})
        return out.drop("_n")
    n = "least(length(chosen), length(rejected))"
    # the longest common start by bisection: 31 comparisons, whatever the length
    bisect = f"aggregate(sequence(1, 31), named_struct('a', 0, 'b', {n}), (s, i) -> if(s.a >= s.b, s, if(left(chosen, (s.a + s.b + 1) div 2) = left(rejected, (s.a + s.b + 1) div 2), named_struct('a', int((s.a + s.b + 1) div 2), 'b', s.b), named_struct('a', s.a, 'b', int((s.a + s.b + 1) div 2 - 1)))), s -> s.a)"
    df = df.withColumn("_n", F.expr(bisect))
    df = df.withColumn("_n", F.expr(f"if(_n = {n} and _n > 0, _n - 1, _n)"))
    back = F.expr("substring(chosen, _n, 1) = ' '") & (F.col("_n") > 0)
    if compat:
        back = back | (F.col("_n") == 0) & F.col("chosen").endswith(" ")
    df = df.withColumn("_n", F.when(back, F.col("_n") - 1).otherwise(F.col("_n")))
    head = lambda c: F.expr(f"case when _n < 0 then left({c}, length({c}) - 1) else left({c}, _n) end")
    tail = lambda c: F.expr(f"case when _n < 0 then right({c}, 1) else substring({c}, _n + 1) end")
    return df.withColumns({"prompt": head("chosen"), "chosen": tail("chosen"), "rejected": tail("rejected")}).drop("_n")


def rendered(messages: Column, generation_prompt: Column | bool = False) -> Column:
    """ChatML rendering; with an opening for the assistant where asked for."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    opening = F.lit("<|im_start|>assistant\n")
    flag = F.lit(generation_prompt) if isinstance(generation_prompt, bool) else generation_prompt
    return F.when(flag, F.concat(body, opening)).otherwise(body)


def apply_template(df: DataFrame) -> DataFrame:
    """Conversational columns as text: prompts open the assistant's turn after a user or tool, completions are what follows the rendered prompt."""
    if not is_conversational(df):
        return df
    if "messages" in df.columns:
        return df.withColumn("text", rendered(F.col("messages"))).drop("messages")
    last = F.try_element_at("prompt", F.lit(-1))["role"]
    known = F.when(last.isin("user", "tool", "assistant"), last.isin("user", "tool")).otherwise(F.raise_error(F.concat(F.lit("invalid role in the last message: "), last)).cast("boolean"))
    prompt = rendered(F.col("prompt"), known)
    out = {c: F.substr(rendered(F.concat("prompt", c)), F.length(prompt) + 1) for c in ("completion", "chosen", "rejected") if c in df.columns}
    return df.withColumns({"prompt": prompt, **out})


def _joined(*columns: str) -> Column:
    return F.concat(*columns)


def convert(df: DataFrame, source: str, target: str) -> DataFrame:
    """Type conversions. Sources: prompt_completion, implicit_preference, preference, unpaired, stepwise."""
    keep = [c for c in df.columns if c not in ("prompt", "completion", "chosen", "rejected", "label", "completions", "labels")]
    text = "messages" if is_conversational(df) else "text"
    done = lambda *c: df.select(*keep, *c)
    match source, target:
        case "prompt_completion", "language_modeling":
            return done(_joined("prompt", "completion").alias(text))
        case ("prompt_completion" | "preference" | "unpaired" | "stepwise"), "prompt_only":
            return done("prompt")
        case "implicit_preference", "language_modeling":
            return done(F.col("chosen").alias(text))
        case "implicit_preference", ("prompt_completion" | "prompt_only" | "preference" | "unpaired"):
            return convert(extract_prompt(df), "preference", target)
        case "preference", "preference":
            return df
        case "preference", "language_modeling":
            return done(_joined("prompt", "chosen").alias(text))
        case "preference", "prompt_completion":
            return done("prompt", F.col("chosen").alias("completion"))
        case "preference", "implicit_preference":
            return done(_joined("prompt", "chosen").alias("chosen"), _joined("prompt", "rejected").alias("rejected"))
        case "preference", "unpaired":
            both = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
            return done("prompt", F.inline(both))
        case "unpaired", "language_modeling":
            return df.where("label").select(*keep, _joined("prompt", "completion").alias(text))
        case "unpaired", "prompt_completion":
            return df.where("label").select(*keep, "prompt", "completion")
        case "stepwise", "language_modeling":
            return df.where(F.forall("labels", lambda x: x)).select(*keep, F.concat("prompt", F.array_join("completions", "")).alias(text))
        case "stepwise", "prompt_completion":
            return df.where(F.forall("labels", lambda x: x)).select(*keep, "prompt", F.array_join("completions", "").alias("completion"))
        case "stepwise", "unpaired":
            return done("prompt", F.array_join("completions", "").alias("completion"), F.forall("labels", lambda x: x).alias("label"))
    raise ValueError(f"no conversion from {source} to {target}")


def with_images(df: DataFrame, messages: str, images: str) -> DataFrame:
    """Message contents as blocks; the images' placeholders open the first user message."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "user")
    marks = F.transform(images, lambda x: F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), x.alias("image")))
    block = lambda m: F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"), F.lit(None).cast("string").alias("image")))
    return df.withColumn(messages, F.transform(messages, lambda m, i: F.struct(m["role"].alias("role"), F.when(i + 1 == first, F.concat(marks, block(m))).otherwise(block(m)).alias("content"))))


def with_eos(c: Column, eos: str) -> Column:
    return F.when(c.endswith(eos), c).otherwise(F.concat(c, F.lit(eos)))


def pairwise_rows(df: DataFrame) -> DataFrame:
    """Chosen and rejected sides as rows with a side column and masks that are 0 on the prompt."""
    one = lambda side: F.struct(F.lit(side).alias("side"), F.concat("prompt_ids", f"{side}_ids").alias("input_ids"), F.concat(F.transform("prompt_ids", lambda _: F.lit(0)), F.transform(f"{side}_ids", lambda _: F.lit(1))).alias("completion_mask"))
    shared = [c for c in df.columns if c not in ("prompt_ids", "chosen_ids", "rejected_ids")]
    return df.select(*shared, F.inline(F.array(one("chosen"), one("rejected"))))
