"""Landed statement rows -> statements, positions and trades, for many files in one job.

Rows are (file_id, page, table_no, row_no, cells); a row belongs to a file, so file_id is not null. The row-by-row reading
state (account, section, asset class, currency, column header, row number) is "last value set before this row" or a count up to
it. All of it comes from one scan over the rows that change it, in segments of a bounded number of rows (:func:`classify_rows`), so a
file is spread over its rows even if a single page or table holds most of them; extractions only filter and project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.functions.text import to_decimal, to_period_date, to_trade_time, with_option_terms
from folioforge.operators.lineage import written_once
from folioforge.operators.scans import SEGMENT_ROWS, in_segments, segment_scan

# Vocabulary of the statement layout.
ASSET_LABELS = {"Stocks": "STK", "Equity and Index Options": "OPT", "ETFs": "ETF"}
SKIPPED_LABELS = ["Bonds", "Futures", "Forex", "Warrants", "Structured Products", "Fund", "Funds", "Cash"]
CURRENCIES = [
    "USD", "SGD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "HKD",
    "MXN", "CNH", "NZD", "SEK", "NOK", "DKK", "KRW", "INR", "BRL",
]
SECTIONS = [
    "Account Information", "Account Summary", "Net Asset Value", "Change in NAV",
    "Mark-to-Market Performance Summary", "Realized & Unrealized Performance Summary", "Cash Report",
    "Open Positions", "Forex Balances", "Net Stock Position Summary", "Trades", "Transaction Fees",
    "Interest", "Dividends", "Withholding Tax", "Notes/Legal Notes", "Time Weighted Rate of Return",
    "Deposits & Withdrawals", "Fees", "Other Fees", "Sales Tax", "Complex Positions Summary",
]
HEADER_WORDS = ["Symbol", "Description"]
POSITION_COLUMNS = {
    "symbol": ["symbol", "description"], "quantity": ["quantity"], "cost_basis": ["cost basis"],
    "market_price": ["close price"], "market_value": ["value"], "unrealized_pnl": ["unrealized p/l"],
}
TRADE_COLUMNS = {
    "symbol": ["symbol", "description"], "trade_date": ["date/time"], "quantity": ["quantity"], "price": ["t. price"],
    "proceeds": ["proceeds"], "commission": ["comm/fee"], "realized_pnl": ["realized p/l"],
}
_MIN_SECTION_PREFIX, _MIN_LABEL_PREFIX = 10, 6
# Cells travel as one text: between them a separator, which is escaped inside them; the escape alone is a row without cells.
_BETWEEN, _ESCAPE = "\x1f", "\x1b"

GROUP = ["file_id", "account_seq"]
_PLACE = ["page", "table_no", "row_no"]


def _first(cells: str = "cells") -> Column:
    return F.trim(F.coalesce(F.get(cells, F.lit(0)), F.lit("")))


def _filled(cells: str = "cells") -> Column:
    """The place of the first cell with text after the first one, 0 if there is none."""
    rest = F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0)))
    return F.array_position(F.transform(rest, lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""), True)


def _match(first: Column, names: list[str], min_prefix: int) -> Column:
    """The name equal to the cell, else a name that starts with a long enough (cut off) cell."""
    starts = F.coalesce(*[F.when(F.lit(n).startswith(first), n) for n in names])
    return F.when(first.isin(names), first).when(F.length(first) >= min_prefix, starts)


def _packed(cells: str = "cells") -> Column:
    """The cells (none of them null) as one text, about two thirds of an array's bytes where rows are sent."""
    escaped = F.transform(cells, lambda c: F.replace(F.replace(c, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_BETWEEN), F.lit(_ESCAPE + "b")))
    return F.when(F.size(cells) == 0, _ESCAPE).when(F.col(cells).isNotNull(), F.array_join(escaped, _BETWEEN))


def _unpacked(text: str = "cells") -> Column:
    """The inverse of :func:`_packed`."""
    plain = F.split(text, _BETWEEN, -1)
    restored = F.transform(plain, lambda c: F.replace(F.replace(c, F.lit(_ESCAPE + "b"), F.lit(_BETWEEN)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE)))
    return F.when(F.col(text) == _ESCAPE, F.array().cast("array<string>")).when(F.contains(text, F.lit(_ESCAPE)), restored).otherwise(plain)


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns that are computed once per row.

    Filters on them are not pushed below, where their expressions would be evaluated again. They are made by a projection, which is
    compiled; the generator only takes them apart.
    """
    kept = [c for c in rows.columns if c not in columns]
    made = rows.select(*kept, F.struct(*[c.alias(n) for n, c in columns.items()]).alias("__made"))
    return made.select(*kept, F.inline(F.array("__made")))


def packed_rows(rows: DataFrame) -> DataFrame:
    """The rows with their cells in one text, null cells as empty text; :func:`classify_rows` takes them with either.

    Most cells hold neither mark and are only joined; the others are escaped one by one.
    """
    joined = F.col("__joined")
    marks = F.length(joined) - F.length(F.replace(joined, F.lit(_BETWEEN)))
    plain = ~F.contains(joined, F.lit(_ESCAPE)) & (marks == F.size("cells") - 1)
    known = rows.withColumn("__joined", F.array_join("cells", _BETWEEN, "")).withColumn(
        "__odd", F.when(~plain, F.transform("cells", lambda c: F.coalesce(c, F.lit("")))))
    return known.withColumn("cells", F.when(F.size("cells") == 0, _ESCAPE).otherwise(F.coalesce(_packed("__odd"), joined))).drop("__joined", "__odd")


def _row_facts(segments: DataFrame) -> DataFrame:
    """What a row's cells say by themselves, found once, as the segments are written; later passes read only these columns.

    ``n`` cells, the ``first`` one, the ``section`` and ``label`` that it names, and ``filled`` (see :func:`_filled`) where it names
    one or a currency: the name counts if the row, cut to its table's width, has no other text.
    """
    first, named = F.col("first"), F.col("section").isNotNull() | F.col("label").isNotNull() | F.col("first").isin(CURRENCIES)
    return (
        segments.withColumn("__cells", _unpacked())
        .withColumns({"n": F.size("__cells"), "first": _first("__cells")})
        .withColumns({"section": _match(first, SECTIONS, _MIN_SECTION_PREFIX), "label": _match(first, [*ASSET_LABELS, *SKIPPED_LABELS], _MIN_LABEL_PREFIX)})
        .withColumn("filled", F.when(named, _filled("__cells"))).drop("__cells")
    )


def _asset_class(label: Column) -> Column:
    """Class code of a label; empty text for unsupported labels, null for no label."""
    out = F.when(label.isin(SKIPPED_LABELS), "")
    for name, code in ASSET_LABELS.items():
        out = out.when(label == name, code)
    return out


def _tables(placed: DataFrame) -> DataFrame:
    """One row per table: whether it starts a section of its own, and the width that its rows take.

    A headless fragment takes the width of the headed table before it; the first table of a file counts as headed.
    Rows are reduced by values of fixed size only, so they are counted in their tasks and never sorted or sent.
    """
    alone = F.coalesce(F.col("filled") == 0, F.lit(False))
    headed = F.col("first").isin(HEADER_WORDS) | (alone & (F.col("section").isNotNull() | F.col("label").isNotNull()))
    at = F.shiftleft(F.col("part").cast("long"), 32) + F.col("seg")
    tables = written_once(placed.groupBy("file_id", "page", "table_no").agg(
        F.min_by(headed, "row_no").alias("headed"), F.max("n").alias("width"), F.min(at).alias("at"),
    ).select(
        "file_id", F.struct("page", "table_no").alias("table"), F.coalesce("headed", F.lit(False)).alias("headed"), "width",
        F.shiftright("at", 32).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("seg")))
    files = tables.groupBy("file_id").agg(F.min("table").alias("first_table"), F.min_by("width", "table").alias("first_width"))
    scanned = segment_scan(tables, ["file_id"], "table", last={"target": F.when(F.col("headed"), F.col("width"))})
    return written_once(scanned.join(files, "file_id").select(
        "file_id", "table.page", "table.table_no", (F.col("headed") | (F.col("table") == F.col("first_table"))).alias("starts"),
        F.coalesce("target", "first_width").alias("target")))


def merge_fragments(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows in segments, headerless table fragments fitted to the preceding headed table of the file.

    Fragment rows take the width of that table (padded or cut); ``kept`` is false for repeated page headers, which later
    steps leave out. ``marker`` is 1 where an account starts, ``place`` numbers the rows of each range without gaps. ``section`` and
    ``label`` are the names that stand ``alone`` in the fitted row, ``n`` its cells.
    """
    clean = rows.where(F.col("page").isNotNull() & F.col("table_no").isNotNull()).select("file_id", *_PLACE, "cells")
    clean = clean if clean.schema["cells"].dataType == StringType() else packed_rows(clean)
    placed = in_segments(clean, ["file_id", *_PLACE], segment_rows, place="place", facts=_row_facts)
    n, target, starts, first = F.col("n"), F.col("target"), F.col("starts"), F.col("first")
    cut = ~starts & (n > target) & (target > 0)
    short = ~starts & (n < target)
    cells = F.col("__cells")
    return (
        placed.join(_tables(placed), ["file_id", "page", "table_no"])
        .withColumns({"__cells": _unpacked(), "alone": (F.col("filled") == 0) | (cut & (F.col("filled") >= target))})
        .select(
            "file_id", "part", "seg", "place", F.struct(*_PLACE).alias("pos"),
            F.when(short, F.concat(cells, F.array_repeat(F.lit(""), target - n))).when(cut, F.slice(cells, F.lit(1), target)).otherwise(cells).alias("cells"),
            F.when(short | cut, target).otherwise(n).alias("n"), "first", "alone",
            F.when(F.col("alone"), F.col("section")).alias("section"), F.when(F.col("alone"), F.col("label")).alias("label"),
            (first == "Account Information").cast("long").alias("marker"), (starts | ~((first == "Open Positions") & F.col("alone"))).alias("kept"))
    )


# Rows that look up their state together: a row compares itself with the state changes among so many rows at most.
_CHUNK_BITS = 10


def _states(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reading state where it changes: (chunk, place, end, state) and one row per state.

    A state holds from ``place`` up to ``end`` (exclusive). Only the rows that set something or are left out are scanned, with
    the first row of a file in each range; all other rows look their state up. ``shift`` + place is the row's number in its account.
    """
    first, pos, marked = F.col("first"), F.col("pos"), F.col("marker") == 1
    put = lambda cond, value: F.when(cond, F.struct(pos.alias("at"), value.alias("value")))
    sets = marked | F.col("section").isNotNull() | F.col("kind").isin("asset", "currency", "header")
    changes = facts.where(~F.col("kept") | sets).select(
        "file_id", "part", "seg", "place", F.lit(1).alias("own"), F.when(F.col("kept"), F.struct(
            "marker", F.when(marked, pos).alias("account_at"),
            put(F.col("section").isNotNull(), F.col("section")).alias("current"),
            put(F.col("kind") == "asset", _asset_class(F.col("label"))).alias("asset"),
            put(F.col("kind") == "currency", first).alias("currency"),
            put(F.col("kind") == "header", F.transform("cells", lambda c: F.lower(F.trim(c)))).alias("header"))).alias("sets"))
    # The rows of a file in a range are neighbours there.
    spans = written_once(facts.groupBy("file_id", "part").agg(
        F.min("place").alias("first_place"), F.count("*").alias("n"), F.min("seg").alias("seg"), F.sum("marker").alias("markers")))
    leading = spans.select("file_id", "part", "seg", F.col("first_place").alias("place"), F.lit(0).alias("own"), F.lit(None).alias("sets"))
    changes = written_once(changes.unionByName(leading).withColumn("order", F.col("place") * 2 + F.col("own")))
    state = segment_scan(changes, ["file_id"], "order", last={n: F.col(f"sets.{n}") for n in ("account_at", "current", "asset", "currency", "header")},
                         sums={"account_seq": F.coalesce("sets.marker", F.lit(0)), "lost": ((F.col("own") == 1) & F.col("sets").isNull()).cast("long")})
    earlier = Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(
        spans.groupBy("file_id").agg(F.sum("markers").alias("markers_in_file")), "file_id")
    following = F.lead("place").over(Window.partitionBy("file_id", "part").orderBy("order"))
    state = state.join(counted.drop("seg"), ["file_id", "part"]).withColumns({
        "end": F.coalesce(following, F.col("first_place") + F.col("n")), "shift": F.col("before") - F.col("first_place") + 1 - F.col("lost")})
    state = written_once(state)
    # Rows of an account are numbered from its marker on, or from the file's first row.
    starts = state.where("sets.marker = 1").select(*GROUP, (F.col("place") + F.col("shift")).alias("__first"))
    here = lambda name: F.when(F.col("account_at").isNull() | (F.col(name)["at"] >= F.col("account_at")), F.col(name)).alias(name)
    # Rows before the first marker belong to no account, unless the file has no marker at all.
    owned = state.where((F.col("place") < F.col("end")) & ((F.col("account_seq") > 0) | (F.col("markers_in_file") == 0))).join(starts, GROUP, "left")
    states = written_once(owned.select(
        F.col("order").alias("state"), "account_seq", (F.col("shift") - F.coalesce("__first", F.lit(1)) + 1).alias("shift"), "place", "end",
        here("current")["value"].alias("current"), here("asset"), here("currency"), here("header")
    ).withColumns({"position_cells": _reach(POSITION_COLUMNS), "trade_cells": _reach(TRADE_COLUMNS)}))
    chunk = lambda place: F.shiftright(place, _CHUNK_BITS)
    spread = written_once(states.select(F.explode(F.sequence(chunk("place"), chunk(F.col("end") - 1))).alias("chunk"), F.col("place").alias("since"), "end", "state"))
    return spread, states.drop("place", "end")


def _reach(columns: dict[str, list[str]]) -> Column:
    """For each field the place of the last header column that names it among the first 0, 1, 2, ... columns; null if none is named at all."""
    header = F.col("header")["value"]
    named = [n for group in columns.values() for n in group]
    last = lambda names: F.transform(F.sequence(F.lit(0), F.size(header)), lambda k: F.array_max(
        F.slice(F.transform(header, lambda h, i: F.when(h.isin(names), i)), F.lit(1), k)))
    return F.when(F.exists(header, lambda h: h.isin(named)), F.array(*[last(names) for names in columns.values()]))


def classify_rows(rows: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Rows of each account with their layout facts and the reading state at each of them.

    Output: file_id, account_seq, row_num (within the account), pos (sortable place), cells, first, section, label, kind; the
    state is ``current`` (section) and ``asset``, ``currency``, ``header``: what was set last in the account, as (at, value) with
    ``at`` the place where it was set; ``position_cells`` and ``trade_cells`` say under which cells the header has the fields. Rows
    are dealt out once, by :func:`in_segments`, which keeps their facts; after that they only look up small tables, so each
    extraction reads the columns that it needs from the segments.
    """
    first = F.col("first")
    kind = (
        F.when(F.col("n") == 0, "empty").when(F.col("section").isNotNull(), "section")
        .when(first.isin(HEADER_WORDS), "header").when(F.col("label").isNotNull(), "asset")
        .when(first.isin(CURRENCIES) & F.col("alone"), "currency").when(first.startswith("Total"), "total").otherwise("data")
    )
    facts = merge_fragments(rows, segment_rows).withColumn("kind", kind)
    spread, states = _states(facts)
    placed = facts.where("kept").withColumn("chunk", F.shiftright("place", _CHUNK_BITS))
    inside = (F.col("place") >= F.col("since")) & (F.col("place") < F.col("end"))
    return placed.join(spread, "chunk").where(inside).join(states, "state").select(
        *GROUP, (F.col("place") + F.col("shift")).alias("row_num"), "pos", "cells", "first", "section", "label", "kind",
        "current", "asset", "currency", "header", "position_cells", "trade_cells",
    )


def statement_headers(classified: DataFrame) -> DataFrame:
    """Account, base currency and period of each account group; missing parts stay null."""
    body = classified.where(F.col("section").isNull() & F.col("current").isin("Account Information", "Net Asset Value"))
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.lit(i)), F.lit("")))
    info = (F.col("current") == "Account Information") & (F.size("cells") >= 2)
    prior, end = to_period_date(cell(0)), to_period_date(cell(2))
    dated = (F.col("current") == "Net Asset Value") & prior.isNotNull() & end.isNotNull()
    at = lambda cond: F.when(cond, F.col("pos"))
    found = body.groupBy(*GROUP).agg(
        F.max_by(cell(1), at(info & (cell(0) == "Account"))).alias("account_id"),
        F.max_by(cell(1), at(info & (cell(0) == "Base Currency"))).alias("base_currency"),
        F.min_by(F.struct(F.date_add(prior, 1).alias("start"), end.alias("end")), at(dated)).alias("period"),
    )
    # Written, so that rows which join it know how small it is and need not be sent.
    return written_once(classified.select(*GROUP).distinct().join(found, GROUP, "left").select(
        *GROUP, F.nullif(F.col("account_id"), F.lit("")).alias("account_id"),
        F.coalesce("base_currency", F.lit("USD")).alias("base_currency"),
        F.col("period.start").alias("period_start"), F.col("period.end").alias("period_end"),
    ))


def _section_bounds(classified: DataFrame, name: str) -> DataFrame:
    """First row of a section per group and the first row of a different section after it."""
    heads = written_once(classified.where(F.col("section").isNotNull()).select(*GROUP, "pos", "section"))
    starts = heads.where(F.col("section") == name).groupBy(*GROUP).agg(F.min("pos").alias("start_pos"))
    ends = heads.join(starts, GROUP).groupBy(*GROUP).agg(
        F.min("start_pos").alias("start_pos"),
        F.min(F.when((F.col("section") != name) & (F.col("pos") > F.col("start_pos")), F.col("pos"))).alias("end_pos"),
    )
    return written_once(ends)


def _section_state(classified: DataFrame, name: str) -> DataFrame:
    """Rows inside the section with the carried asset class, currency and column header."""
    inside = classified.join(_section_bounds(classified, name), GROUP).where(
        (F.col("pos") >= F.col("start_pos")) & (F.col("end_pos").isNull() | (F.col("pos") < F.col("end_pos")))
    )
    return _since_start(inside).withColumn("currency", F.coalesce("currency", F.lit("USD")))


def _since_start(rows: DataFrame) -> DataFrame:
    """The state columns as plain values, null where they were set before the section started."""
    value = lambda name: F.when(F.col(name)["at"] >= F.col("start_pos"), F.col(name)["value"])
    return rows.withColumns({
        "asset_class": F.nullif(value("asset"), F.lit("")), "currency": value("currency"), "header": value("header"),
        **{c: F.when(F.col("header")["at"] >= F.col("start_pos"), F.col(c)) for c in ("position_cells", "trade_cells")},
    }).drop("asset")


def _field(reach: str, columns: dict[str, list[str]], name: str) -> Column:
    """Cell under the last header column of the field that the row reaches."""
    places = F.get(reach, F.lit([*columns].index(name)))
    return F.trim(F.get("cells", F.get(places, F.least(F.size("cells"), F.size(places) - 1))))


def _data_rows(state: DataFrame, reach: str, columns: dict[str, list[str]]) -> DataFrame:
    """Data rows of a mapped table with the text of each field as ``in_<field>``; a symbol is needed."""
    rows = state.where((F.col("kind") == "data") & F.col("asset_class").isNotNull() & F.col(reach).isNotNull())
    read = computed(rows, **{f"in_{name}": _field(reach, columns, name) for name in columns})
    return read.withColumnRenamed("in_symbol", "symbol").where(F.coalesce("symbol", F.lit("")) != "")


def _typed(rows: DataFrame, numbers: list[str], **more: Column) -> DataFrame:
    """Numbers, option terms and further columns from the field texts, each parsed once."""
    read = with_option_terms(rows, F.when(F.col("asset_class") == "OPT", F.col("symbol")))
    terms = {t: F.col("terms")[t] for t in ("expiry", "strike", "right")}
    return computed(read, **{f: to_decimal(F.col(f"in_{f}")) for f in numbers}, **terms, **more).drop("terms")


def extract_positions(classified: DataFrame, headers: DataFrame) -> DataFrame:
    """Open positions of every account group, not yet validated (see the position rules)."""
    numbers = ["quantity", "cost_basis", "market_price", "market_value", "unrealized_pnl"]
    rows = _typed(_data_rows(_section_state(classified, "Open Positions"), "position_cells", POSITION_COLUMNS), numbers)
    return rows.join(headers, GROUP).select(
        *GROUP, "account_id", "symbol", "asset_class", *numbers, "currency",
        F.col("period_end").alias("statement_date"), "expiry", "strike", "right", "cells",
    )


def extract_trades(classified: DataFrame, headers: DataFrame) -> DataFrame:
    """Trades of every account group: side from the sign, zero quantities dropped, not yet validated."""
    numbers = ["price", "proceeds", "commission", "realized_pnl"]
    rows = _data_rows(_section_state(classified, "Trades"), "trade_cells", TRADE_COLUMNS)
    typed = _typed(rows, numbers, signed=to_decimal(F.col("in_quantity")), trade_date=to_trade_time(F.col("in_trade_date")))
    sided = typed.where(F.col("signed") != 0).withColumns(
        {"side": F.when(F.col("signed") > 0, "BOT").otherwise("SLD"), "quantity": F.abs("signed")})
    return sided.join(headers, GROUP).select(
        *GROUP, "account_id", "trade_date", "symbol", "asset_class", "side", "quantity", *numbers,
        "currency", "expiry", "strike", "right", "cells",
    )


def diagnose(classified: DataFrame) -> DataFrame:
    """Class of every row up to the end of the positions section, with running row numbers.

    Classes: empty, section_header, column_header, asset_class, asset_class_skipped, currency,
    total, parsed, error, skipped_no_asset_class, skipped_no_mapping, skipped_empty_symbol,
    outside_section.
    """
    bounds = _section_bounds(classified, "Open Positions")
    placed = classified.join(bounds, GROUP, "left").where(
        F.col("end_pos").isNull() | (F.col("pos") <= F.col("end_pos"))
    )
    before = F.col("start_pos").isNull() | (F.col("pos") < F.col("start_pos"))
    symbol = F.coalesce(_field("position_cells", POSITION_COLUMNS, "symbol"), F.lit(""))
    state = computed(_since_start(placed), symbol=symbol)
    state = with_option_terms(state, F.when(F.col("asset_class") == "OPT", F.col("symbol")))
    complete = (F.col("asset_class") != "OPT") | (F.col("terms")["expiry"].isNotNull() & F.col("terms")["strike"].isNotNull())
    kind = F.col("kind")
    label = (
        F.when(kind == "empty", "empty").when(before, "outside_section").when(kind == "section", "section_header")
        .when(kind == "header", "column_header")
        .when((kind == "asset") & F.col("label").isin(list(ASSET_LABELS)), "asset_class")
        .when(kind == "asset", "asset_class_skipped").when(kind == "currency", "currency").when(kind == "total", "total")
        .when(F.col("asset_class").isNull(), "skipped_no_asset_class")
        .when(F.col("position_cells").isNull(), "skipped_no_mapping")
        .when(F.col("symbol") == "", "skipped_empty_symbol")
        .when(complete, "parsed").otherwise("error")
    )
    detail = F.when(F.col("symbol") != "", F.col("symbol")).otherwise(F.col("first"))
    return computed(state, classification=label, detail=detail).select(
        *GROUP, F.col("row_num").cast("long").alias("row_num"), "cells", "first", "classification", "asset_class", "detail")


# Classes counted as problems.
PROBLEM_CLASSES = ["skipped_no_asset_class", "skipped_no_mapping", "skipped_empty_symbol", "error"]


def diagnosis_counts(diagnosed: DataFrame) -> DataFrame:
    """Per account group: parsed, skipped or failed, headers and totals, outside rows."""
    of = lambda names: F.count_if(F.col("classification").isin(names))
    return diagnosed.groupBy(*GROUP).agg(
        F.count("*").alias("rows"), of(["parsed"]).alias("parsed"), of(PROBLEM_CLASSES).alias("skipped"),
        of(["total", "column_header", "section_header"]).alias("headers"), of(["outside_section"]).alias("outside"),
    )


def search_rows(diagnosed: DataFrame, text: str) -> DataFrame:
    """Rows whose detail or first cell contains the text, ignoring case."""
    needle = text.strip().lower()
    return diagnosed.where(F.lower("detail").contains(needle) | F.lower("first").contains(needle))


def problem_context(diagnosed: DataFrame, before: int = 10, after: int = 5) -> DataFrame:
    """Rows from ``before`` rows ahead of a problem row to ``after`` rows behind it.

    Problems are spread to the row numbers they cover and matched by an equi-join, so no window has
    to hold a whole file.
    """
    covered = (
        diagnosed.where(F.col("classification").isin(PROBLEM_CLASSES))
        .select(*GROUP, F.explode(F.sequence(F.col("row_num") - before, F.col("row_num") + after)).alias("row_num"))
        .distinct()
    )
    covered = written_once(covered)
    return diagnosed.join(covered, [*GROUP, "row_num"], "left_semi")
