"""Rows and columns of datasets: choice of a source, splits, strict positional joins, views of completions, row checks."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import convert


def choose_source(mixture: Sequence | None, name: str | None) -> tuple[str, object]:
    """("mixture", parts) if there is one, else ("name", name). A mixture wins over a name, with a warning; neither is an error."""
    if mixture:
        if name:
            warnings.warn("both a mixture and a name are given; the name is ignored", stacklevel=2)
        return "mixture", list(mixture)
    if name:
        return "name", name
    raise ValueError("give a mixture or the name of a dataset")


def adapted_splits(splits: Mapping[str, DataFrame], train: str, evaluation: str, testing: bool = False) -> tuple[DataFrame | None, DataFrame | None]:
    """The splits to train and to evaluate on: none to train on when only testing, none to evaluate on where that split is absent."""
    return None if testing else splits[train], splits.get(evaluation)


def shared_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The columns of ``df`` that are wanted, in its order; wanted ones that it lacks are passed over."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(wanted)])


def maybe_extract_prompt(df: DataFrame) -> DataFrame:
    """``convert.extract_prompt`` for preference data, unless there is a prompt of the same kind (messages or text) as the chosen side."""
    if not {"chosen", "rejected"} <= set(df.columns):
        return df
    if "prompt" in df.columns and convert.is_conversational(df.select("prompt")) == convert.is_conversational(df.select("chosen")):
        return df
    return convert.extract_prompt(df)


def strictly_zipped(**arrays: str) -> Column:
    """Structs of the elements at each place. Arrays of different lengths are an error (null arrays have none)."""
    sizes = [f"coalesce(size({a}), -1)" for a in arrays.values()]
    same = " and ".join(f"{sizes[0]} = {s}" for s in sizes[1:]) or "true"
    fields = ", ".join(f"'{n}', {a}[i__]" for n, a in arrays.items())
    first = next(iter(arrays.values()))
    return F.when(F.expr(same), F.expr(f"transform({first}, (x__, i__) -> named_struct({fields}))")).otherwise(F.raise_error(F.lit("arrays of different lengths")))


def positional_join(left: DataFrame, right: DataFrame, ordinal: str | Sequence[str]) -> DataFrame:
    """Columns of both sides by their common ordinal. An ordinal that one side lacks is an error, as unequal lengths are."""
    keys = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), keys, "full")
    met = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.where(F.when(met, F.lit(True)).otherwise(F.raise_error(F.lit("sides of different lengths")))).drop("_l", "_r")


def handled_ids(validated: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Ids that were decided on, either way, once."""
    return validated.select(key).union(rejected.select(key)).distinct()


def first_by(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row for each value of the keys, that of the least ordinal (which is distinct). Combined before the shuffle."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.col(ordinal))
    return df.groupBy(*keys).agg(first.alias("_f")).select("_f.*")


def completions_to_log(df: DataFrame, logged: DataFrame | None, step: str, every: int) -> DataFrame:
    """Rows to append to a log of completions: steps divisible by ``every`` that are not in it yet."""
    due = df.where(F.pmod(F.col(step), F.lit(every)) == 0)
    return due if logged is None else due.join(logged.select(step).distinct(), step, "left_anti")


def chunked(df: DataFrame, ordinal: str, n: int, total: int, name: str = "chunk") -> DataFrame:
    """n chunks of total // n rows each, by an ordinal from 0; the rows that are left over are dropped, as the operation defines."""
    size = total // n
    if not size:
        raise ValueError("fewer rows than chunks")
    number = F.floor(F.col(ordinal) / size)
    return df.where(number < n).withColumn(name, number)


def checked(df: DataFrame, key: str, text: Sequence[str] = (), whole: Sequence[str] = (), numeric: Sequence[str] = ()) -> DataFrame:
    """``df`` if the fields have their types and no nulls. A missing or ill-typed column is an error at once, a null when its row is read."""
    kinds = {c: t for c, t in df.dtypes}
    ints, floats = ("tinyint", "smallint", "int", "bigint"), ("float", "double")
    for names, good in ((text, ("string",)), (whole, ints), (numeric, (*ints, *floats))):
        for c in names:
            if kinds.get(c) not in good and not (good != ("string",) and kinds.get(c, "").startswith("decimal")):
                raise ValueError(f"field {c!r} must be one of {good}, is {kinds.get(c)}")
    bad = F.lit(False)
    for c in (*text, *whole, *numeric):
        bad |= F.col(c).isNull()
    message = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("unknown")), F.lit(": a required field is null"))
    return df.where(F.when(bad, F.raise_error(message)).otherwise(F.lit(True)))


def pair_within(chosen: str, rejected: str, most: int) -> Column:
    """Whether both sides have at most so many ids."""
    return F.expr(f"size({chosen}) <= {most} and size({rejected}) <= {most}")


def nested_prefixes(rendered: str) -> Column:
    """Whether each rendered conversation opens the next longer one (an array, shortest first)."""
    return F.expr(f"forall(sequence(0, greatest(size({rendered}) - 2, 0)), i__ -> size({rendered}) < 2 or startswith({rendered}[i__ + 1], {rendered}[i__]))")


def renamed_images(contents: str) -> Column:
    """Content parts (type, value) with the type image_pil for image."""
    return F.expr(f"transform({contents}, c__ -> named_struct('type', if(c__.type = 'image', 'image_pil', c__.type), 'value', c__.value))")


def without_nulls(c: Column) -> Column:
    """A struct as JSON without fields that are null, at any depth; null elements of lists stay."""
    return F.to_json(c, {"ignoreNullFields": "true"})


def split_by_counts(values: str, counts: str) -> Column:
    """A flat array cut into consecutive parts of these lengths (pixels by the products of their grids)."""
    start = f"aggregate(slice({counts}, 1, i__), 0, (s__, x__) -> s__ + int(x__))"
    return F.expr(f"transform({counts}, (n__, i__) -> slice({values}, 1 + {start}, int(n__)))")


# ------------------------------------------------------------------ code examples in their usual shapes


def filled(*names: str) -> Column:
    """The first of these string columns that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names])


def example_id(index: Column, *names: str) -> Column:
    """The first id that is there, else q_ and the index."""
    return F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names], F.concat(F.lit("q_"), index.cast("string")))


def io_mode(explicit: Column, has_stdio: Column) -> Column:
    """The stated mode, trimmed and lower-cased; without one, stdio if a case has stdin and stdout, else call. Any other mode is an error."""
    said = F.lower(F.trim(explicit))
    mode = F.when(F.coalesce(said, F.lit("")) != "", said).when(has_stdio, "stdio").otherwise("call")
    return F.when(mode.isin("call", "stdio"), mode).otherwise(F.raise_error(F.concat(F.lit("unsupported io mode: "), mode)))


# ------------------------------------------------------------------ dialogues of one text

# The marks of turns.
HUMAN, ASSISTANT = "\n\nHuman: ", "\n\nAssistant: "


def common_start(a: Column, b: Column) -> Column:
    """What both strings begin with, by halving the length in question."""
    steps = F.sequence(F.lit(0), F.lit(30))
    most = F.least(F.length(a), F.length(b))

    def halve(k: Column, i: Column) -> Column:
        longer = k + F.expr("1L") * F.pow(F.lit(2.0), F.lit(30) - i).cast("long")
        return F.when((longer <= most) & (F.left(a, longer.cast("int")) == F.left(b, longer.cast("int"))), longer).otherwise(k)

    return F.left(a, F.aggregate(steps, F.lit(0).cast("long"), halve).cast("int"))


def dialogue(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """prompt (messages), chosen and rejected (the last answers) of two dialogues that begin alike.

    The common start is cut back to the last assistant mark in it; what follows are the two answers.
    """
    start = common_start(F.col(chosen), F.col(rejected))
    turns = F.length(start) - F.length(F.substring_index(start, ASSISTANT, -1))
    cut = df.withColumn("_cut", F.greatest(turns, F.lit(len(ASSISTANT))))
    kept = "substring({c}, _cut + 1)"
    mark = "\u0001"
    parts = F.split(F.replace(F.replace(F.expr(f"left({chosen}, _cut - {len(ASSISTANT)})"), F.lit(HUMAN), F.lit(f"{mark}user:")), F.lit(ASSISTANT), F.lit(f"{mark}assistant:")), mark)
    messages = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, ":", 1).alias("role"), p.substr(F.instr(p, ":") + 1, F.length(p)).alias("content")))
    return cut.select(*[F.col(c) for c in df.columns if c not in ("prompt", chosen, rejected)], messages.alias("prompt"), F.expr(kept.format(c=chosen)).alias("chosen"), F.expr(kept.format(c=rejected)).alias("rejected"))
