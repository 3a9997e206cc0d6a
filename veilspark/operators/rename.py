"""Consistent renaming: definitions, rename map, rewritten texts, and pseudonyms for prose."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.patterns import JS_TEMPLATE_PIECE, LINE_BREAK, LINE_WITH_BREAK, PRIVATE_REFERENCE
from veilspark.functions.text import private_name
from veilspark.operators.files import route_files
from veilspark.operators.js_code import js_definitions, reference_units, template_parts
from veilspark.operators.python_code import python_definitions, strip_comments
from veilspark.operators.python_syntax import python_error
from veilspark.operators.scan import _any_rule, has_match, merged_places
from veilspark.operators.splicing import JS_LEXER, PY_LEXER, ROW, apply_edits, by_key, by_row
from veilspark.operators.text_tables import CLOSERS, KEY, OPENERS
from veilspark.rules import Rule, check_rules
from veilspark.session import once


def protected(name: Column, keep: Iterable[str]) -> Column:
    """Is the name on the keep list? Exact, or by prefix for entries that end with ``*``."""
    entries = list(keep)
    exact = [e for e in entries if not e.endswith("*")]
    out = name.isin(exact) if exact else F.lit(False)
    for e in entries:
        if e.endswith("*"):
            out = out | (name == e) | name.startswith(e.rstrip("*"))
    return out


def protect_names(names: DataFrame, keep: Iterable[str], name: str = "name") -> DataFrame:
    """Drop names on the keep list. The list is configuration and becomes one expression, not a join."""
    return names.where(~protected(F.col(name), keep))


def renamable(corpus: DataFrame) -> DataFrame:
    """Rows that a rename may touch: a supported language, readable, and for Python without a syntax error."""
    routed = route_files(corpus)
    error = once(F.when(F.col("route") == "python", python_error(F.col("text"))))
    ok = (F.col("route") != "unsupported") & F.col("text").isNotNull() & error.isNull()
    return routed.withColumn("transformed", ok)


def definitions(corpus: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, ln, pos, nth, kind, name, depth)`` for every supported file."""
    k = list(key)
    rows = route_files(corpus).where(F.col("text").isNotNull())
    py = by_key(rows.where("route = 'python'").select(*k, "text"), key)
    js = by_key(rows.where("route = 'js'").select(*k, "text"), key)
    return python_definitions(py, key).unionByName(js_definitions(js, key))


def private_definitions(corpus: DataFrame, keep: Iterable[str] = (), key: Sequence[str] = KEY) -> DataFrame:
    """``(path, name, pos, nth)``: module-level private names by first occurrence, less the keep list."""
    k = list(key)
    # A file without any leading-underscore name never enters the token tables, nor is it looked at for errors.
    rows = route_files(corpus).where(F.col("text").rlike(PRIVATE_REFERENCE))
    fit = renamable(rows.where("route = 'python'")).where("transformed")
    keep = list(keep)

    def first(defs: DataFrame, lang: str) -> DataFrame:
        mine = defs.where((F.col("depth") == 0) & private_name("name", F.lit(lang)))
        order = F.min(F.struct("pos", "nth")).alias("at")
        return protect_names(mine, keep).groupBy(*k, "name").agg(order).select(*k, "name", "at.pos", "at.nth")

    py = python_definitions(by_key(fit.select(*k, "text"), key), key)
    js = js_definitions(by_key(rows.where("route = 'js'").select(*k, "text"), key), key)
    return first(py, "python").unionByName(first(js, "javascript"))


def rename_map(defs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(path, original, renamed)``: ``_a000``, ``_a001``, ... per file in order of definition."""
    order = Window.partitionBy(*key).orderBy("pos", *(["nth"] if "nth" in defs.columns else []), "name")
    number = (F.row_number().over(order) - 1).cast("int")
    return defs.select(*key, F.col("name").alias("original"), F.format_string("_a%03d", number).alias("renamed"))


def _python_references(base: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(key, pos, sig, name)``: private names as identifiers or inside f-string fields.

    Import statements name what other files define, so they are left as they are.
    """
    k = list(key)
    cut = base.select(*k, F.posexplode(PY_LEXER.units(F.col("text"))).alias("pos", "unit"))
    cut = cut.select(*k, "pos", "unit", PY_LEXER.head(F.col("unit")).alias("sig")).where("sig <> ''")
    blanks = F.substring(F.col("unit"), F.length("sig") + 1, F.length("unit"))
    cut = cut.select(*k, "pos", "sig", F.replace(blanks, F.lit("\\\n"), F.lit("")).contains("\n").alias("nl"))
    by_pos = Window.partitionBy(*k).orderBy("pos")
    step = F.when(F.col("sig").isin(*OPENERS), 1).when(F.col("sig").isin(*CLOSERS), -1).otherwise(0)
    u = cut.select(
        *k,
        "pos",
        "sig",
        F.lag("sig", 1, "").over(by_pos).alias("prev"),
        F.lead("sig", 1, "").over(by_pos).alias("next"),
        F.sum(step).over(by_pos.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"),
        F.lag("nl", 1, True).over(by_pos).alias("first"),
    )
    begins = (F.col("first") & (F.col("depth") - step <= 0)) | (F.col("prev") == ";")
    begins = begins | (F.col("sig").isin("import", "from") & (F.col("prev") == ":"))
    statement = F.last(F.when(begins, F.col("sig")), ignorenulls=True).over(by_pos)
    u = u.withColumn("statement", statement).where(~F.col("statement").isin("import", "from"))
    keyword = (F.col("depth") > 0) & (F.col("next") == "=") & F.col("prev").isin("(", ",")
    plain = F.col("sig").startswith("_") & (F.col("prev") != ".") & ~keyword
    formatted = F.col("sig").rlike(r"^(?i:f|fr|rf)[\"']")
    names = F.array_distinct(
        F.regexp_extract_all("sig", F.lit(PRIVATE_REFERENCE + r"(?=[^{}]*\})"), F.lit(0))
    )
    return u.where(plain | formatted).select(
        *k, "pos", "sig", F.explode(F.when(plain, F.array("sig")).otherwise(names)).alias("name")
    )


_FSTRING_PIECE = PRIVATE_REFERENCE + r"(?=[^{}]*\})|[\s\S]"


def _rename_in(sig: Column, names: Column) -> Column:
    """All renames of one unit at once, so that a new name is never renamed again."""
    pieces = F.regexp_extract_all(sig, F.lit(_FSTRING_PIECE), F.lit(0))
    lookup = F.map_from_entries(names)
    swapped = F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, p), p))
    return F.when(sig.startswith("_"), F.element_at(names, 1)["renamed"]).otherwise(F.array_join(swapped, ""))


def _rename_in_js(sig: Column, names: Column) -> Column:
    """All renames of a name or of the code inside a template literal."""
    lookup = F.map_from_entries(names)

    def swapped(p: Column) -> Column:
        pieces = F.regexp_extract_all(p["code"], F.lit(JS_TEMPLATE_PIECE), F.lit(0))
        return F.concat(F.array_join(F.transform(pieces, lambda c: F.coalesce(F.try_element_at(lookup, c), c)), ""), p["rest"])

    template = F.array_join(F.transform(template_parts(sig), swapped), "${")
    return F.when(sig.startswith("_"), F.element_at(names, 1)["renamed"]).otherwise(template)


def apply_renames(corpus: DataFrame, renames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Rewrite every reference to a renamed identifier, file by file; other rows keep their text.

    Only units that are private names are joined with the map, and both sides are placed by file, so the
    texts move once. Python comments are removed from transformed files, as a rewrite from the syntax tree
    would do.
    """
    k = list(key)
    routed = route_files(corpus)
    readable = F.col("text").isNotNull()
    others = routed.where((F.col("route") == "unsupported") | ~readable).select(*k, "text")
    new = by_key(renames.select(*k, F.col("original").alias("name"), "renamed"), key)

    def python(df: DataFrame) -> DataFrame:
        # Files with an error stay as they are. They come along, so that errors are looked for once: both readers of the
        # placed rows use the flag, and share them.
        plain, fit = strip_comments(F.col("text")), F.col("transformed")
        bare = df.select(*k, F.when(fit, plain).alias("text"))
        df = df.select(*k, F.when(fit, plain).otherwise(F.col("text")).alias("text"))
        edits = _python_references(bare, key).join(new, [*k, "name"])
        per_unit = edits.groupBy(*k, "pos").agg(
            F.first("sig").alias("sig"), F.collect_list(F.struct("name", "renamed")).alias("names")
        )
        cuts = per_unit.select(
            *k, F.col("pos").alias("a"), F.col("pos").alias("b"), _rename_in(F.col("sig"), F.col("names")).alias("with")
        )
        return apply_edits(df, cuts, PY_LEXER, key)

    def js(df: DataFrame) -> DataFrame:
        edits = reference_units(df, key).join(new, [*k, "name"])
        per_unit = edits.groupBy(*k, "pos").agg(
            F.first("sig").alias("sig"), F.collect_list(F.struct("name", "renamed")).alias("names")
        )
        cuts = per_unit.select(
            *k, F.col("pos").alias("a"), F.col("pos").alias("b"), _rename_in_js(F.col("sig"), F.col("names")).alias("with")
        )
        return apply_edits(df, cuts, JS_LEXER, key)

    py_rows = renamable(routed.where((F.col("route") == "python") & readable)).select(*k, "text", "transformed")
    js_rows = routed.where((F.col("route") == "js") & readable).select(*k, "text")
    return (
        python(by_key(py_rows, key)).select(*k, "text")
        .unionByName(js(by_key(js_rows, key)).select(*k, "text"))
        .unionByName(others)
    )


def passthrough(before: DataFrame, after: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Every row of ``before``, with the text of ``after`` where there is one."""
    new = after.select(*key, F.col("text").alias("new_text"))
    joined = before.join(new, list(key), "left")
    return joined.withColumn("text", F.coalesce("new_text", "text")).drop("new_text")


def transform_counts(before: DataFrame, renames: DataFrame) -> DataFrame:
    """One row: files transformed, files copied through, renames."""
    files = renamable(before).select(F.col("transformed").cast("int").alias("t"), (~F.col("transformed")).cast("int").alias("c"), F.lit(0).alias("r"))
    names = renames.select(F.lit(0).alias("t"), F.lit(0).alias("c"), F.lit(1).alias("r"))

    def total(c: str, name: str):
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name)

    return files.unionByName(names).agg(
        total("t", "files_transformed"), total("c", "files_copied"), total("r", "renames")
    )


def _entities(lines: DataFrame, rules: Sequence[Rule], keep: Sequence[str], k: list[str]) -> DataFrame:
    """``(<k>, ln, a, b, rule_id, value)``: what is replaced in each line, from character a up to b.

    Values come from matches in their line and are never matched again. Matches that overlap are one entity under
    the rule of the leftmost (then of the earlier rule), so no part of a match stays. All of that is decided inside the row.
    """
    found = lines.select(*k, "ln", "line", F.explode(merged_places(F.col("line"), rules, keep)).alias("m"))
    ids = F.array(*[F.lit(r.id) for r in rules])
    value = F.substring("line", F.col("m.start") + 1, F.col("m.end") - F.col("m.start"))
    return found.select(*k, "ln", F.col("m.start").alias("a"), F.col("m.end").alias("b"), F.element_at(ids, F.col("m.rule") + 1).alias("rule_id"), value.alias("value"))


def _with_aliases(lines: Column, hits: Column) -> Column:
    """The lines joined, those of ``hits`` (sorted by line, with sorted edits) with their aliases put in."""

    def line(h: Column) -> Column:
        text, edits = F.element_at(lines, h["ln"] + 1), h["edits"]

        def put(e: Column, j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.element_at(edits, F.greatest(j, F.lit(1)))["b"])
            return F.concat(F.substring(text, start + 1, e["a"] - start), e["alias"])

        tail = F.substring(text, F.element_at(edits, -1)["b"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(edits, put), ""), tail)

    def piece(h: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.element_at(hits, F.greatest(i, F.lit(1)))["ln"] + 1)
        return F.concat(F.array_join(F.slice(lines, start + 1, h["ln"] - start), ""), line(h))

    last = F.element_at(hits, -1)["ln"]
    tail = F.slice(lines, last + 2, F.greatest(F.size(lines) - last - 1, F.lit(0)))
    return F.concat(F.array_join(F.transform(hits, piece), ""), F.array_join(tail, ""))


def pseudonymize(
    corpus: DataFrame, rules: Sequence[Rule], keep: Iterable[str] = (), key: Sequence[str] = KEY
) -> tuple[DataFrame, DataFrame]:
    """Stable aliases per row for the entities that rules find: ``(corpus, map)``.

    ``map`` is ``(path, rule_id, original, renamed)``; aliases are ``<RULE>_000``, ... in order of first
    appearance. Rules are searched line by line, as in the scan, so anchors, look-around and back-references hold;
    rules that the engine can't compile are left out (``check_rules`` tells which). Only rows with a match are cut
    up, after one placement by key; rows that share a key are numbered each for itself.
    """
    k, keep = list(key), list(keep)
    rules = check_rules(corpus.sparkSession, rules)[0]
    if not rules:
        empty = ", ".join(f"{c} string" for c in [*k, "rule_id", "original", "renamed"])
        return corpus, corpus.sparkSession.createDataFrame([], empty)
    has = has_match(F.col("text"), rules)
    own = [*k, ROW]
    base = by_row(corpus.where(has).select(*k, "text"), key)
    all_lines = F.regexp_extract_all("text", F.lit(LINE_WITH_BREAK), F.lit(0))
    body = F.regexp_replace("line", F.lit("(?:" + LINE_BREAK + r")\z"), F.lit(""))
    lines = base.select(*own, F.posexplode(all_lines).alias("ln", "line")).select(*own, "ln", body.alias("line"))
    found = _entities(lines.where(_any_rule(F.col("line"), rules)), rules, keep, own)
    seen = F.min(F.struct("ln", "a")).over(Window.partitionBy(*own, "rule_id", "value"))
    found = found.withColumn("seen", seen)
    rank = F.dense_rank().over(Window.partitionBy(*own, "rule_id").orderBy("seen"))
    alias = F.concat(F.upper("rule_id"), F.lit("_"), F.format_string("%03d", (rank - 1).cast("int")))
    found = found.withColumn("alias", alias)
    by_line = found.groupBy(*own, "ln").agg(F.array_sort(F.collect_list(F.struct("a", "b", "alias"))).alias("edits"))
    hits = by_line.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("ln", "edits"))).alias("hits"))
    joined = base.join(hits, own, "left").withColumn("lines", F.when(F.col("hits").isNotNull(), all_lines))
    text = F.when(F.col("hits").isNotNull(), _with_aliases(F.col("lines"), F.col("hits"))).otherwise(F.col("text"))
    mapping = found.where((F.col("seen.ln") == F.col("ln")) & (F.col("seen.a") == F.col("a"))).select(
        *k, "rule_id", F.col("value").alias("original"), F.col("alias").alias("renamed")
    )
    return joined.select(*k, text.alias("text")).unionByName(corpus.where(~has).select(*k, "text")), mapping


def rename_entries(renames: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """``(entry, renamed)`` with entries ``path:original``."""
    return renames.select(F.concat_ws(":", *key, "original").alias("entry"), "renamed")
