"""What agents do around a language model: tool calls, histories, routing, prompts."""

from __future__ import annotations

import ast
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import written

CALL = r"(?s)(?U)TOOL_CALL:\s*(\w+)\((.*?)\)"


def tool_calls(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys, pos, name, args_text): every call in a text, in order; arguments end at the first closing parenthesis."""
    names, args = (F.regexp_extract_all(text_col, F.lit(CALL), F.lit(i)) for i in (1, 2))
    calls = F.arrays_zip(names.alias("name"), args.alias("args"))
    return df.select(*keys, F.posexplode(calls).alias("pos", "c")).select(*keys, "pos", F.col("c.name").alias("name"), F.trim("c.args").alias("args_text"))


def parse_arguments(text: str | None) -> dict[str, str]:
    """key=value pairs with literal values, as text; anything else gives no arguments. Nothing is ever evaluated."""
    try:
        call = ast.parse(f"f({text or ''})", mode="eval").body
        if call.args or any(k.arg is None for k in call.keywords):
            return {}
        return {k.arg: str(ast.literal_eval(k.value)) for k in call.keywords}
    except (SyntaxError, ValueError, TypeError, MemoryError, RecursionError):
        return {}


def balanced_calls(text: str | None) -> list[tuple[str, str]]:
    """(name, arguments) of every call, closing parentheses inside arguments and quotes respected."""
    import re

    out, t = [], text or ""
    for m in re.finditer(r"TOOL_CALL:\s*(\w+)\(", t):
        depth, quote, i = 1, "", m.end()
        while i < len(t) and depth:
            c = t[i]
            if quote:
                i += c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            i += 1
        if not depth:
            out.append((m[1], t[m.end() : i - 1].strip()))
    return out


def parsed_calls(df: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """(keys, pos, name, args): every call with balanced arguments, as a map (Python, in Arrow batches)."""
    @F.pandas_udf("array<struct<name: string, args: map<string, string>>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"name": n, "args": parse_arguments(a)} for n, a in balanced_calls(t)])

    return df.select(*keys, F.posexplode(parse(F.col(text_col))).alias("pos", "c")).select(*keys, "pos", "c.name", "c.args")


def registry_of(sources: Sequence[DataFrame]) -> DataFrame:
    """Tools of several servers, in order; of tools with one name the first stays."""
    both = None
    for i, s in enumerate(sources):
        s = s.withColumn("_source", F.lit(i))
        both = s if both is None else both.unionByName(s)
    first = F.row_number().over(W.partitionBy("name").orderBy("_source", "ord"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n", "_source")


def dispatched(calls: DataFrame, tools: DataFrame) -> DataFrame:
    """Calls with their tool's description as result, or "<name> not found"."""
    known = tools.select("name", F.col("description").alias("_d"))
    return calls.join(known, "name", "left").withColumn("result", F.coalesce("_d", F.concat("name", F.lit(" not found")))).drop("_d")


def history(df: DataFrame, by: str, order: str, n: int = 3) -> DataFrame:
    """The last n rows of each conversation, with place from 1 in rising order."""
    last = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("_r", last).where(F.col("_r") <= n).withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(order))).drop("_r")


def merged_messages(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Messages with those of an equal id replaced by the last; an aggregate, so a hot id is combined before shuffling."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m")).select(*key, "_m.*")


def listing(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str], separator: str = "\n") -> DataFrame:
    """(by, n, listing): values joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(rows, lambda r: r["_v"]), separator).alias("listing"))


def routed(df: DataFrame, edges: DataFrame, state: str = "state", condition: str = "cond") -> DataFrame:
    """The next node of each row: the edge of its condition, else the unconditional one (null condition), else END."""
    e = edges.select(F.col("src").alias(state), F.col("cond").alias("_c"), F.col("dst").alias("_d"))
    exact = e.where("_c is not null").withColumnRenamed("_c", condition)
    free = e.where("_c is null").select(state, F.col("_d").alias("_f"))
    return df.join(exact, [state, condition], "left").join(free, state, "left").withColumn("next", F.coalesce("_d", "_f", F.lit("END"))).drop("_d", "_f")


def schema_text(tools: DataFrame) -> DataFrame:
    """(name, text): a tool with its arguments, types and whether they are required, from a JSON schema."""
    kind = "struct<properties: map<string, struct<type: string>>, required: array<string>>"
    s = tools.withColumn("_s", F.from_json("schema", kind))
    line = lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), F.coalesce(e["value"]["type"], F.lit("unknown")), F.when(F.array_contains(F.coalesce(F.col("_s.required"), F.array().cast("array<string>")), e["key"]), F.lit(" (required)")).otherwise(F.lit("")))
    args = F.array_join(F.transform(F.map_entries("_s.properties"), line), "\n")
    with_args = F.concat("name", F.lit("(\n"), args, F.lit("\n)\nDescription: "), "description", F.lit("\n"))
    return s.select("name", F.when(F.col("_s.properties").isNotNull(), with_args).otherwise(F.concat("name", F.lit(": "), "description", F.lit("\n"))).alias("text"))


def agent_loop(start: DataFrame, step, pending: Column, limit: int = 3) -> DataFrame:
    """Apply step to the rows that are pending, limit times at most; others stay as they are. Each pass is written to the
    shared folder, so none is worked out twice; the loop ends early where nothing is pending."""
    now = start
    for _ in range(limit):
        if now.where(pending).isEmpty():
            return now
        now = written(now.where(F.coalesce(~pending, F.lit(True))).unionByName(step(now.where(pending))))
    return now


def chosen_tools(tools: DataFrame, names: Sequence[str], leave_out: bool = False) -> DataFrame:
    """The tools named, or with leave_out all others."""
    named = F.col("name").isin(*names)
    return tools.where(~named if leave_out else named)


def prompt(template: str, **values: Column) -> Column:
    """A text with {name} replaced by the value of that name; null values are empty."""
    import re

    parts = [F.coalesce(values[x[1:-1]].cast("string"), F.lit("")) if x[0] == "{" else F.lit(x) for x in re.findall(r"\{\w+\}|[^{]+", template)]
    return F.concat(*parts)


def policy_match(requests: DataFrame, kinds: Sequence[str], namespaces: Sequence[str], operations: Sequence[str]) -> DataFrame:
    """Requests that an admission policy applies to: of one of the kinds, namespaces and operations."""
    return requests.where(F.col("kind").isin(*kinds) & F.col("namespace").isin(*namespaces) & F.col("operation").isin(*operations))


def load_registries(loaders: Sequence) -> tuple[list[DataFrame], list[str]]:
    """(tables, errors): what each loader, a function without arguments, gives; one that fails is noted and left out."""
    out, errors = [], []
    for load in loaders:
        try:
            out.append(load())
        except Exception as e:  # noqa: BLE001  a server that can't be reached must not stop the others
            errors.append(f"{getattr(load, '__name__', 'loader')}: {type(e).__name__}")
    return out, errors
