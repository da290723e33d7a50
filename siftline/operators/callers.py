"""Who calls a symbol: call, import and member sites as one relation, followed ring by ring with equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftline.functions.fixed_values import CONSTRUCTOR_BODY, CONSTRUCTOR_LINE, DEFINING, DEFINING_SHAPE, IMPORT_WORDS
from siftline.functions.text import bounded, edge, insensitive, let, line_array, match_columns, quoted, row_text
from siftline.operators.symbols import SYMBOL, symbol_array
from siftline.sources.scratch import stored

IDENTIFIER = r"[\w$]+"
CALLED = r"(?<![\w$])([\w$]+)(?=\s*\()"
IMPORTING = IMPORT_WORDS + r"[^\n]*"
MEMBER = r"\.([\w$]+)"
#: What a site can be, by its number in the column form.
FORMS = ("call", "import", "member")


#: Symbols of a ring up to this many go into the expressions that look for their sites; more meet the sites by a join.
AMONG = 10_000


def sites(files: DataFrame, ignore_case: bool = False, owners: bool = True, among: list[str] | None = None) -> DataFrame:
    """path, line, col, text, sym, form (0 call, 1 import, 2 member), owner (the nearest symbol above, null unless asked for) of each site.

    Lines that define the symbol are no sites of it. One pass over the texts serves any number of symbols. among: the symbols whose sites
    are wanted; lines that name none of them go no further than that test, and no site of another symbol leaves its row.
    """
    fold = F.lower if ignore_case else (lambda c: c)
    none = F.slice(F.array(F.struct(F.lit("").alias("sym"), F.lit(0).alias("col"), F.lit(0).alias("form"))), 1, 0)

    def named(raw: Column, pattern: str, form: int) -> Column:
        names = F.regexp_extract_all(raw, F.lit(pattern), F.lit(1))
        return F.zip_with(names, match_columns(raw, pattern), lambda sym, col: F.struct(sym.alias("sym"), col.alias("col"), F.lit(form).alias("form")))

    def imported(raw: Column) -> Column:
        names = F.regexp_extract_all(F.regexp_replace(F.regexp_extract(raw, IMPORTING, 0), "^" + IMPORT_WORDS, ""), F.lit(f"({IDENTIFIER})"), F.lit(1))
        at = F.element_at(match_columns(raw, IMPORTING), 1)
        return let(at, lambda col: F.transform(F.array_distinct(names), lambda x: F.struct(x.alias("sym"), col.alias("col"), F.lit(1).alias("form"))))

    def membered(raw: Column) -> Column:
        # A member's name up to a `$` counts as well: there a word ends.
        cut = lambda some: F.transform(F.filter(some, lambda x: F.contains(x["sym"], F.lit("$"))), lambda x: x.withField("sym", F.regexp_extract(x["sym"], r"^\w+", 0)))
        return let(named(raw, MEMBER, 2), lambda some: F.concat(some, F.filter(cut(some), lambda x: x["sym"] != "")))

    def wanted(sym: Column) -> Column:
        return F.lit(True) if among is None else fold(sym).isin(among)

    def touches(raw: Column) -> Column:
        if among is None:
            return F.lit(True)
        tokens = lambda pattern: F.exists(F.regexp_extract_all(raw, F.lit(pattern), F.lit(1)), wanted)
        return tokens(f"({IDENTIFIER})") | (F.contains(raw, F.lit("$")) & tokens(r"(\w+)"))

    def of_line(raw: Column, i: Column, symbols: Column) -> Column:
        def of_text(text: Column) -> Column:
            shape = F.regexp_extract(text, DEFINING_SHAPE + rf"({IDENTIFIER})\s*\([^;]*\)\s*[:{{]", 1)
            every = F.concat(
                F.when(F.contains(raw, F.lit("(")), named(raw, CALLED, 0)).otherwise(none),
                F.when(raw.rlike(IMPORT_WORDS), imported(raw)).otherwise(none),
                F.when(F.contains(raw, F.lit(".")), membered(raw)).otherwise(none),
            )
            kept = let(shape, lambda defined: F.filter(every, lambda x: wanted(x["sym"]) & (fold(x["sym"]) != fold(defined)) & ~_constructs(text, x["sym"])))
            row = lambda x, owner: F.struct((i + 1).alias("line"), x["col"].alias("col"), text.alias("text"), fold(x["sym"]).alias("sym"), x["form"].alias("form"), owner.alias("owner"))
            owner = _owner(symbols, i + 1) if owners else F.lit(None).cast("string")
            return F.when(~text.rlike(DEFINING), let(owner, lambda owner: F.transform(kept, lambda x: row(x, owner))))

        return F.when(raw.rlike(r"[(.]|" + IMPORT_WORDS) & touches(raw), let(row_text(raw), of_text))

    return _exploded(files, of_line, owners)


def _owner(symbols: Column, line: Column) -> Column:
    return F.try_element_at(F.filter(symbols, lambda s: s["line"] <= line), F.lit(-1))["name"]


def _exploded(files: DataFrame, of_line, owners: bool) -> DataFrame:
    """path and the fields of what of_line(raw, index, symbols) gives for each line; lines and symbols are worked out once a file."""

    def of_symbols(lines: Column, symbols: Column) -> Column:
        return F.flatten(F.array_compact(F.transform(lines, lambda raw, i: of_line(raw, i, symbols))))

    def of_lines(lines: Column) -> Column:
        return let(symbol_array(lines, F.col("path"), 1), lambda s: of_symbols(lines, s)) if owners else of_symbols(lines, F.lit(None).cast(f"array<{SYMBOL}>"))

    found = files.select("path", F.explode(let(line_array(F.col("text")), of_lines)).alias("x"))
    return found.select("path", "x.*")


def _constructs(text: Column, name: Column) -> Column:
    """constructor( at the start of a line, or before a body, is a definition."""
    starts = text.rlike("(?i)" + CONSTRUCTOR_LINE) | text.rlike("(?i)" + CONSTRUCTOR_BODY)
    return (F.lower(name) == "constructor") & starts


def mentions(symbol: str, ignore_case: bool = False) -> Column:
    """Whether a text contains the symbol anywhere; a test that may let too much through."""
    if not ignore_case:
        return F.contains(F.col("text"), F.lit(symbol))
    # A different case has a different length in few alphabets; those go on to the expressions.
    return F.contains(F.lower("text"), F.lit(symbol.lower())) if symbol.isascii() else F.lit(True)


def pattern_sites(files: DataFrame, symbol: str, ignore_case: bool, owners: bool) -> DataFrame:
    """As sites, of one symbol of any shape, without owners unless asked; only lines that contain it are looked at."""
    flag = insensitive if ignore_case else (lambda p: p)
    esc, name = quoted(symbol), bounded(quoted(symbol))
    own = rf"(?<![\w$]){esc}(?![\w$])"
    forms = [rf"{own}\s*\(", IMPORTING + own, r"\." + esc + edge(esc, False)]
    defines = "|".join(f"(?:{p})" for p in (DEFINING + r"[^\n]*" + name, DEFINING_SHAPE + name + r"\s*\([^;]*\)\s*[:{]"))
    near = flag(rf"(?<![\w$]){esc}" + edge(esc, False))  # every form has this in it

    def of_line(raw: Column, i: Column, symbols: Column) -> Column:
        each = F.concat(*[_tagged(match_columns(raw, flag(p)), form) for form, p in enumerate(forms)])
        owner = _owner(symbols, i + 1) if owners else F.lit(None).cast("string")
        rows = lambda text: F.transform(each, lambda x: F.struct((i + 1).alias("line"), x["col"].alias("col"), text.alias("text"), x["form"].alias("form"), owner.alias("owner")))
        of_text = lambda text: F.when(~text.rlike(flag(defines)) & ~_constructs(text, F.lit(symbol)), rows(text))
        return F.when(raw.rlike(near), let(row_text(raw), of_text))

    found = _exploded(files.filter(mentions(symbol, ignore_case) & F.col("text").rlike(near)), of_line, owners)
    return found.select("path", "line", "col", "text", F.lit(symbol.lower() if ignore_case else symbol).alias("sym"), "form", "owner")


def _tagged(columns: Column, form: int) -> Column:
    return F.transform(columns, lambda c: F.struct(c.alias("col"), F.lit(form).alias("form")))


def callers(files: DataFrame, symbol: str, depth: int = 1, ignore_case: bool = False, forms: tuple[str, ...] = FORMS) -> DataFrame:
    """path, line, col, text, depth, via: the sites of symbol, then those of the symbols around them, each line once. forms: the kinds of sites that count.

    A ring is an equi-join of sites and symbols, less the lines that were seen. Rings before the last are stored, as later ones
    start from them. Each ring looks for the sites of its symbols alone, unless they are more than AMONG, and for owners only if a ring follows.
    """
    if not symbol:
        raise ValueError("a symbol is needed")
    depth = max(1, min(3, depth))
    counts = F.col("form").isin([FORMS.index(x) for x in forms])
    spark = files.sparkSession
    first = symbol.lower() if ignore_case else symbol
    ring = pattern_sites(files, symbol, ignore_case, owners=depth > 1).filter(counts).withColumn("rank", F.lit(None).cast("struct<path:string,line:int>"))
    out = _once(ring).withColumn("depth", F.lit(1))
    if depth > 1:
        asked = spark.createDataFrame([(first,)], "sym string")
    for n in range(2, depth + 1):
        out = stored(out)
        last = out.filter(F.col("depth") == n - 1)
        fold = F.lower if ignore_case else (lambda c: c)
        # Symbols in the order in which their sites come; that order decides which symbol a line is found by.
        around = last.filter("owner IS NOT NULL").groupBy(fold(F.col("owner")).alias("sym")).agg(F.min(F.struct("path", "line")).alias("rank"))
        around = stored(around.join(asked, "sym", "left_anti"))
        asked = asked.unionByName(around.select("sym"))
        some = [r.sym for r in around.select("sym").limit(AMONG + 1).collect()]
        known = sites(files, ignore_case, n < depth, some if len(some) <= AMONG else None)
        ring = known.filter(counts).join(around, "sym").join(out.select("path", "line"), ["path", "line"], "left_anti")
        out = out.unionByName(_once(ring).withColumn("depth", F.lit(n)))
    return out.select("path", "line", "col", "text", "depth", F.col("sym").alias("via"))


def _once(ring: DataFrame) -> DataFrame:
    """One row a line: the first by symbol, form, column."""
    order = Window.partitionBy("path", "line").orderBy("rank", "form", "col")
    first = ring.withColumn("n", F.row_number().over(order)).filter("n = 1")
    return first.select("path", "line", "col", "text", "sym", "owner")


def certainty(text: Column, via: str | Column, ignore_case: bool = False) -> Column:
    """exact for calls and imports of the symbol, else possible. A symbol column takes plain identifiers."""
    flag = "(?i)" if ignore_case else ""
    if isinstance(via, str):
        name = F.lit(bounded(quoted(via)))
    else:
        name = F.concat(F.lit(r"\b"), F.regexp_replace(via, r"\$", r"\\\\\$"), F.lit(r"\b"))
    exact = F.regexp_like(text, F.concat(F.lit(flag), name, F.lit(r"\s*\("))) | F.regexp_like(text, F.concat(F.lit(flag + IMPORTING), name))
    return F.when(exact, "exact").otherwise("possible")
