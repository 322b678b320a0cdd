"""CSV and JSON-like text as columns: token streams that give back the exact bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token letters, the characters of tokens, of integers and of floats.
INT, FLOAT, STRING, TRUE, FALSE, NULL = "A", "B", "C", "D", "E", "F"
TOKEN = r"[ !#-+\--9;-Z^-z|~]+"
INT_TOKEN, FLOAT_TOKEN = r"\A[0-9-]+\z", r"\A[0-9+\-.eE]+\z"


def json_tokens(text: Column) -> Column:
    """Maximal runs of token characters, in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_kind(token: Column) -> Column:
    return F.when(token == "true", TRUE).when(token == "false", FALSE).when(token == "null", NULL).when(token.rlike(INT_TOKEN), INT).when(token.rlike(FLOAT_TOKEN), FLOAT).otherwise(STRING)


def json_extract(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, pos, token, kind): dispatch to streams is a filter on kind."""
    rows = df.select(*keys, F.posexplode(json_tokens(F.col(text))).alias("pos", "token"))
    return rows.withColumn("kind", token_kind(F.col("token")))


def json_skeleton(text: Column) -> Column:
    """The text with each token replaced by the letter of its kind."""
    kinds = F.transform(json_tokens(text), token_kind)
    gaps = F.split(text, TOKEN, -1)
    joined = F.zip_with(gaps, kinds, lambda g, k: F.concat(g, F.coalesce(k, F.lit(""))))
    return F.array_join(joined, "")


def json_restore(skeleton: Column, tokens: Column) -> Column:
    """The text again from its skeleton and tokens (an array in order)."""
    gaps = F.split(skeleton, "[A-F]", -1)
    return F.array_join(F.zip_with(gaps, tokens, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def _outside(stops: str) -> str:
    """Regular expression of a stretch up to one of stops, over quoted parts whole; possessive, so that long ones need no stack."""
    return f'[^"{stops}]*+(?:"[^"]*+"[^"{stops}]*+)*+'


def csv_rows(content: Column) -> Column:
    """Array of the rows of a text with their line ends; line ends within quotes stay. Unclosed quotes are an error."""
    sure = F.assert_true(F.length(content) - F.length(F.translate(content, '"', "")) - 2 * F.regexp_count(content, F.lit('"[^"]*+"')) == 0, F.lit("unclosed quote"))
    found = F.regexp_extract_all(content, F.lit("(" + _outside("\n") + r")(?:\n|\z)"), F.lit(0))
    return F.when(sure.isNull(), F.filter(found, lambda r: r != ""))


def csv_fields(row: Column, separator: str = ",") -> Column:
    """Array of the fields of a row, with their quotes, empty ones too."""
    import re

    sep = re.escape(separator)
    return F.regexp_extract_all(F.concat(F.lit(separator), row), F.lit(f"{sep}({_outside(sep + chr(10))})"), F.lit(1))


def csv_lex(files: DataFrame, content: str, keys: list[str], separator: str = ",", null_aware: bool = False) -> DataFrame:
    """(keys, pos, row, col, kind, token): the tokens of csv_token_lists, a row each."""
    return csv_token_lists(files, content, keys, separator, null_aware).select(*keys, F.inline("tokens"))


def csv_token_lists(files: DataFrame, content: str, keys: list[str], separator: str = ",", null_aware: bool = False) -> DataFrame:
    """(keys, tokens: pos, row, col, kind, token) of whole texts, with built-in functions only; kinds are field, sep and newline.

    The tokens in order are the text again. A quoted field runs to its closing quote and keeps its quotes. Only \\n ends a row,
    \\r stays in its field. Fields are tokens also where they are empty, but after a separator that ends the text. In
    null-aware mode consecutive separators are one token and empty fields are none, but the last of a row after a separator.
    Unclosed quotes, and rows that end in \\n of another number of fields than the first, are errors. A separator or line end
    has the column of the field before it.
    """
    # columns of their own, so that Spark finds rows and fields once
    rows = files.select(*keys, csv_rows(F.coalesce(F.col(content), F.lit(""))).alias("_rows"))
    rows = rows.select(*keys, F.transform("_rows", lambda r: r.endswith("\n")).alias("_ended"), F.transform("_rows", lambda r: csv_fields(r, separator)).alias("_fields"))

    def token(row, col, kind: str, text: Column) -> Column:
        return F.struct(row.cast("long").alias("row"), col.cast("long").alias("col"), F.lit(kind).alias("kind"), text.alias("token"))

    def tokens(fields: Column, i: Column) -> Column:
        ended = F.get("_ended", i)
        last = F.size(fields) - 1
        end = F.when(ended, F.array(token(i, last, "newline", F.lit("\n")))).otherwise(F.array())
        if null_aware:
            there = F.filter(F.sequence(F.lit(0), last), lambda j: (F.get(fields, j) != "") | (j == last) & (j > 0))
            before = F.concat(F.array(F.lit(0)), there)
            body = F.flatten(F.zip_with(there, F.slice(before, 1, F.size(there)), lambda j, b: F.concat(F.when(j > b, F.array(token(i, b, "sep", F.repeat(F.lit(separator), j - b)))).otherwise(F.array()), F.when((F.get(fields, j) != "") | ended, F.array(token(i, j, "field", F.get(fields, j)))).otherwise(F.array()))))
        else:
            pairs = F.flatten(F.transform(fields, lambda f, j: F.array(token(i, j - 1, "sep", F.lit(separator)), token(i, j, "field", f))))
            body = F.slice(pairs, 2, F.size(pairs) - 1 - (~ended & (last > 0) & (F.get(fields, last) == "")).cast("int"))
        return F.concat(body, end)

    even = F.forall(F.zip_with("_fields", "_ended", lambda f, ended: ~ended | (F.size(f) == F.size(F.get("_fields", F.lit(0))))), lambda x: x)
    sure = F.when(F.assert_true(even, F.lit("rows of unequal width")).isNull(), F.flatten(F.transform("_fields", tokens)))
    placed = F.transform(sure, lambda t, i: F.struct(i.cast("long").alias("pos"), *[t[c].alias(c) for c in ("row", "col", "kind", "token")]))
    return rows.select(*keys, placed.alias("tokens"))


def csv_dispatch(tokens: DataFrame, keys: list[str], header: bool = True) -> dict[str, DataFrame]:
    """Streams of csv_lex's tokens: `header` (all of row 0), `fields` (keys, pos, row, tag: the column, field), `separators` (with line ends).

    With the positions that all of them keep, csv_collect gives the texts again; fields of one tag are a stream for a cluster.
    """
    body = tokens.where("row > 0") if header else tokens
    out = {"fields": body.where("kind = 'field'").select(*keys, "pos", "row", F.col("col").alias("tag"), F.col("token").alias("field")), "separators": body.where("kind <> 'field'").select(*keys, "pos", "token")}
    return out | ({"header": tokens.where("row = 0").select(*keys, "pos", "token")} if header else {})


def csv_collect(streams: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, content) again from the streams of csv_dispatch."""
    whole = streams["separators"].union(streams["fields"].select(*keys, "pos", F.col("field").alias("token")))
    whole = whole.union(streams["header"]) if "header" in streams else whole
    return whole.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "").alias("content"))


def csv_split_lists(lists: DataFrame, keys: list[str], header: bool = True) -> DataFrame:
    """The streams of csv_dispatch as arrays of each text (keys, header, fields, separators) from csv_token_lists: nothing is shuffled or lexed again."""

    def some(keep, **named: str) -> Column:
        return F.transform(F.filter("tokens", keep), lambda t: F.struct(*[t[c].alias(n) for n, c in named.items()]))

    body = lambda t: t["row"] > 0 if header else F.lit(True)
    return lists.select(
        *keys, some(lambda t: ~body(t), pos="pos", token="token").alias("header"), some(lambda t: body(t) & (t["kind"] == "field"), pos="pos", row="row", tag="col", field="token").alias("fields"),
        some(lambda t: body(t) & (t["kind"] != "field"), pos="pos", token="token").alias("separators"))


def csv_join_lists(streams: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content) again from the streams of csv_split_lists; a text without tokens is empty."""
    fields = F.transform("fields", lambda t: F.struct(t["pos"].alias("pos"), t["field"].alias("token")))
    return streams.select(*keys, F.sort_array(F.concat("header", fields, "separators")).alias("_all")).select(*keys, F.array_join(F.transform("_all", lambda t: t["token"]), "").alias("content"))


def csv_melt(lines: DataFrame, line: str, keys: list[str], separator: str = ",") -> DataFrame:
    """(keys, col, field) of unquoted rows, one per line, with built-in functions only."""
    import re

    return lines.select(*keys, F.posexplode(F.split(F.col(line), re.escape(separator), -1)).alias("col", "field"))


def csv_segments(lines: DataFrame, line: str, order: str, rows_per_key: int, size: int) -> DataFrame:
    """(chunk, first, last, bytes): rows cut at row ends into chunks of at least `size` bytes within stretches of keys."""
    from pyspark.sql import Window

    stretch = F.floor(F.col(order) / rows_per_key)
    bytes_ = F.octet_length(line) + 1
    before = F.sum(bytes_).over(Window.partitionBy(stretch).orderBy(order)) - bytes_
    placed = lines.select(order, stretch.alias("stretch"), bytes_.alias("b"), F.floor(before / size).alias("part"))
    return placed.groupBy("stretch", "part").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum("b").alias("bytes"))
