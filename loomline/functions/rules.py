"""Rules of records: terminals, strips, currents, warnings, review decisions, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import differs, reasons

# The closed vocabulary of terminal strips and what device names stand for.
STRIPS = ("X0", "X1", "X21/X23", "X22/X24", "X3", "X4", "X5", "X21", "X22", "X23", "X24", "X6", "X61")
STRIP_OF_DEVICE = {
    "XD0": "X0", "XA": "X1", "XD10": "X1", "XD11": "X1", "XD12": "X1", "XD21": "X21", "XD23": "X23", "XD22": "X22", "XD24": "X24",
    "XD3": "X3", "XD5": "X3", "XD4": "X4", "XH": "X5",
}
STRIP_ALIASES = {"XD0": "X0", "XD21/XD23": "X21/X23", "XD22/XD24": "X22/X24"}
CURRENT_BASES = ("IR", "IN", "IE")
# Patterns of what is no physical terminal, and bars that need no device.
PLC_ADDRESS = r"(?i)^[IQ]\d+\.\d+$"
POTENTIAL_LABEL = r"(?i)(?:^|:)\w+_(?:L\d?|N|PE|\+|-)(?:\.\d+)?$"
BARS = ("N-BAR", "PE-BAR")
SUPPLIES = ("L1", "L2", "L3", "N", "PE")
# Review codes with their messages, by completion state where one has them.
UNCERTAIN_ENDS = {
    "unavailable": ("target_unavailable", "跨页目标或图片不可用"),
    "conflicting": ("target_conflict", "多个目标返回不同终点"),
    "failed": ("completion_failed", "补全未能产生可确认的结果"),
}
DIRECTION = ("direction_unconfirmed", "direction", "起终点方向缺少可确认的图纸依据")
MISSING_TERMINAL = {"start": "起点端子未确认", "end": "终点端子未确认"}
NOT_PHYSICAL = "PLC地址或电位名称不能作为实际端子"
NO_IDENTITY = "缺少所属元件或端子排身份"
NO_EVIDENCE = ("completion_evidence_missing", "end", "补全结果缺少目标路径依据")
UNCLEAR = "图像信息不明确"
NO_SHEET = ("page", "来源Sheet无法确认，原理号留空")
UNREADABLE = ("connection", "标记数字可见但无法辨认，原理号留空")
NO_MARKER = ("connection", "本段无可确认标记编号或完整实际端子，原理号留空")
#: What a start is, and the fields of a record that say it.
START = ("location", "device", "board", "terminal", "conflict")
START_FIELDS = ("start_code", "start_location", "start_device", "start_terminal_board", "start_terminal", "location", "device", "terminal_board", "terminal")
# What a correction's issue leads to: action, stages, estimated model calls.
PATCH_STAGES = ("VALIDATION", "PROPOSAL")
SCAN_STAGES = ("PAGE_SCAN", *PATCH_STAGES)
ROUTES = {
    "SOURCE_INSUFFICIENT": ("NO_ACTION", (), 0),
    "DIRECT_VALUE_CHANGE": ("DIRECT_PATCH", PATCH_STAGES, 0),
    "FORMAT_OR_ORDER": ("DETERMINISTIC_ONLY", PATCH_STAGES, 0),
}


def text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def terminal_strip(device: Column, mapping: dict[str, str] | None = None) -> Column:
    """The strip that a device or strip name stands for, or null. A leading hyphen doesn't count. A caller's mapping takes the
    place of STRIP_OF_DEVICE; aliases come before it, and what it maps to no known strip is unknown."""
    key = F.regexp_replace(F.upper(text(device)), "^-+", "")
    named = {k: v.strip().upper().lstrip("-") for k, v in (mapping or STRIP_OF_DEVICE).items()}
    pairs = ({k: v for k, v in named.items() if v in STRIPS} | STRIP_ALIASES).items()
    table = F.create_map(*[F.lit(x) for pair in pairs for x in pair])
    return F.when(key.isin(*STRIPS), key).otherwise(F.try_element_at(table, key))


def complete_terminal(terminal: Column, board: Column) -> Column:
    """A pin alone gets its board before it; the full-width colon is a colon; a strip name alone is no terminal."""
    t = F.replace(text(terminal), F.lit("："), F.lit(":"))
    b = F.regexp_replace(text(board), "^-+", "")
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(t.contains(":"), t)
        .when(F.upper(t).rlike(r"^X[A-Z]?\d+$"), F.lit(None).cast("string"))
        .when(b != "", F.concat(b, F.lit(":"), t))
        .otherwise(t)
    )


def breaker_current(value: Column, basis: Column, evidence: Column) -> Column:
    """`63 a` as 63A where the evidence names the basis; else null."""
    named = F.regexp_replace(F.upper(basis), "[^A-Z]", "")
    plain = F.replace(text(value), F.lit(" "), F.lit(""))
    number, unit = F.regexp_extract(plain, r"(?i)^(\d+(?:\.\d+)?)(mA|A|kA)$", 1), F.lower(F.regexp_extract(plain, r"(?i)^(\d+(?:\.\d+)?)(mA|A|kA)$", 2))
    said = F.regexp_like(text(evidence), F.concat(F.lit(r"(?i)\b"), named, F.lit(r"\b\s*[:=]")))
    shown = F.when(unit == "ma", "mA").when(unit == "ka", "kA").otherwise("A")
    return F.when(named.isin(*CURRENT_BASES) & said & (number != ""), F.concat(number, shown))


def sheet_current(value: Column, evidence: Column) -> Column:
    """A current whose evidence is no range and no voltage."""
    bad = evidence.rlike(r"\d\s*[-–]\s*\d|\b[0-9.]+\s*[kK]?[vV]\b")
    return F.when((text(evidence) != "") & ~bad, F.nullif(text(value), F.lit("")))


def endpoint_warnings(terminal: Column, device: Column, board: Column) -> Column:
    t = text(terminal)
    nameless = (F.coalesce(F.nullif(text(device), F.lit("")), text(board)) == "") & ~t.contains(":") & ~F.upper(t).isin(*BARS)
    return reasons(
        [
            (t == "", "missing physical terminal"),
            ((t != "") & t.rlike(PLC_ADDRESS), "PLC address is not a physical terminal"),
            ((t != "") & ~t.rlike(PLC_ADDRESS) & t.rlike(POTENTIAL_LABEL), "potential label is not a physical terminal"),
            (nameless, "missing device or terminal board identity"),
        ]
    )


def consistency_warnings(number: Column, start: Column, end: Column, device: Column, strict: bool = False, source: Column | None = None) -> Column:
    """Special rows: SPARE has only `*` as terminals, PE only PE, and PE-BAR where endpoints must have an identity (`strict`); others
    need a start terminal with a start device."""
    n = F.upper(text(number))
    star = lambda c: c.isNull() | (c == "*")
    last = lambda c: F.upper(F.substring_index(c, ":", -1))
    pe = lambda c: c.isNull() | (c == "") | last(c).isin("PE", *(["PE-BAR"] if strict else []))
    where = F.lit("record") if source is None else F.coalesce(F.nullif(source, F.lit("")), F.lit("record"))
    warnings = reasons(
        [
            ((n == "SPARE") & ~(star(start) & star(end)), "SPARE record has a non-* terminal"),
            ((n == "PE") & ~(pe(start) & pe(end)), "PE record has a non-PE terminal"),
        ]
    )
    nameless = ~n.isin("SPARE", "PE") & (F.coalesce(device, F.lit("")) != "") & start.isNull()
    return F.when(nameless, F.array(F.concat(where, F.lit(" has a start device but no start terminal")))).otherwise(warnings)


def sheet_warnings(number: Column, start: Column, end: Column, state: Column) -> Column:
    return reasons(
        [
            (text(number) == "", "no principle number"),
            (text(start) == "", "no start terminal"),
            ((state == "cross_page") & (text(end) == ""), "still needs cross-page review"),
        ]
    )


def review_reasons(r: dict[str, Column], phase: str, strict: bool) -> Column:
    """What a reviewer must see, in order and each once: an array of (code, field, message). `r` has endpoint_role, direction_basis,
    line_number, for start and end *_terminal, *_device and *_terminal_board, completion_state, has_evidence, and arrays: references
    (reason), uncertainties (field, detail), warnings. While scanning, an end that a reference will bring isn't missing yet."""
    none = F.array().cast("array<struct<code: string, field: string, message: string>>")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    reason = lambda code, field, message: F.struct(F.lit(code).alias("code"), field.cast("string").alias("field"), message.alias("message"))
    fixed = lambda when, code, field, message: F.when(when, F.array(reason(code, F.lit(field), F.lit(message)))).otherwise(none)
    # lambdas are interpreted with all below them, so only rows that have something for them get there
    each = lambda when, values, made: F.when(when & (F.size(values) > 0), F.transform(values, made)).otherwise(none)
    references, uncertainties = r["references"], r["uncertainties"]
    pending = F.lit(phase == "scan") & ~given(r["end_terminal"]) & F.coalesce(F.size(references) > 0, F.lit(False))
    unsure = F.coalesce(r["endpoint_role"] == "unknown", F.lit(False)) | (F.lit(strict) & (text(r["direction_basis"]) == ""))
    spare = F.upper(F.coalesce(r["line_number"], F.lit(""))) == "SPARE"
    parts = [fixed(unsure, *DIRECTION)]
    for side in ("start", "end"):
        asked = ~pending if side == "end" else F.lit(True)
        terminal = text(r[f"{side}_terminal"])
        strictly = asked & F.lit(strict) & ~spare & (terminal != "")
        owned = given(r[f"{side}_device"]) | given(r[f"{side}_terminal_board"]) | terminal.contains(":") | F.upper(terminal).isin(*BARS)
        parts += [
            fixed(asked & (terminal == ""), f"missing_{side}_terminal", f"{side}_terminal", MISSING_TERMINAL[side]),
            fixed(strictly & (terminal.rlike(PLC_ADDRESS) | terminal.rlike(POTENTIAL_LABEL)), "non_physical_terminal", f"{side}_terminal", NOT_PHYSICAL),
            fixed(strictly & ~owned, "endpoint_identity_incomplete", side, NO_IDENTITY),
        ]
    if phase == "final":
        state = r["completion_state"]
        parts += [fixed(state == name, code, "end", message) for name, (code, message) in UNCERTAIN_ENDS.items()]
        parts.append(fixed((state == "resolved") & F.lit(strict) & ~F.coalesce(r["has_evidence"], F.lit(False)), *NO_EVIDENCE))
        named = F.filter(references, lambda x: given(x["reason"]))
        parts.append(each(~given(r["end_terminal"]), named, lambda x: reason("reference_unresolved", F.lit("references"), x["reason"])))
    unclear = lambda u: reason("visual_uncertainty", u["field"], F.coalesce(F.nullif(u["detail"], F.lit("")), F.lit(UNCLEAR)))
    brought = F.filter(uncertainties, lambda u: ~F.coalesce(u["field"] == "end", F.lit(False)))
    parts.append(F.when(pending, each(F.lit(True), brought, unclear)).otherwise(each(F.lit(True), uncertainties, unclear)))
    parts.append(each(F.lit(True), r["warnings"], lambda w: reason("profile_validation", F.lit(None), w)))
    return F.array_distinct(F.concat(*parts))


def processing_status(end: Column, has_reference: Column, phase: str) -> Column:
    if phase != "scan":
        return F.lit("completed")
    return F.when((text(end) == "") & has_reference, "pending_completion").otherwise("scanned")


def cross_page_state(has_reference: Column, end: Column, said: Column) -> Column:
    kept = F.when(said.isin("same_page", "cross_page", "unknown"), said).otherwise("unknown")
    return F.when(has_reference, "cross_page").when(text(end) != "", "same_page").otherwise(kept)


def edit(row: dict[str, Column], kind: str, **how) -> dict[str, Column]:
    """What an edit sets: remove_prefix (endpoint, prefix), swap_endpoints, swap_terminals, or set_fields (changes). Coordinates whose
    terminal changes are cleared unless the edit brings its own, and a row left without a terminal needs review."""
    out: dict[str, Column] = {}
    if kind == "remove_prefix":
        field = f"{how['endpoint']}_terminal"
        cut = F.nullif(F.substring(row[field], F.lit(len(how["prefix"]) + 1), F.char_length(row[field])), F.lit(""))
        out[field] = F.when(row[field].startswith(how["prefix"]), cut).otherwise(row[field])
    elif kind in ("swap_endpoints", "swap_terminals"):
        names = ("terminal",) if kind == "swap_terminals" else ("terminal", "code", "description", "coordinates")
        for name in names:
            for a, b in (("start", "end"), ("end", "start")):
                if f"{a}_{name}" in row:
                    out[f"{a}_{name}"] = row[f"{b}_{name}"]
    elif kind == "set_fields":
        out |= how["changes"]
    else:
        raise ValueError(f"no such edit: {kind}")
    after = row | out
    for side in ("start", "end"):
        point = f"{side}_coordinates"
        if point in row:
            stale = differs(after[f"{side}_terminal"], row[f"{side}_terminal"]) & after[point].eqNullSafe(row[point])
            out[point] = F.when(stale, F.lit(None)).otherwise(after[point])
    touched = F.lit(False)
    for name, value in out.items():
        touched = touched | differs(value, row[name])
    empty = (text(after["start_terminal"]) == "") | (text(after["end_terminal"]) == "")
    if "needs_review" in row:
        out["needs_review"] = F.when(touched & empty, F.lit(True)).otherwise(row["needs_review"])
    return out


def changed_only(row: dict[str, Column], edited: dict[str, Column]) -> Column:
    """A map of the columns that an edit changes, as text."""
    entries = [F.when(differs(v, row[k]), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"))) for k, v in edited.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def start_identity(r: dict[str, Column]) -> Column:
    """A start as (location, device, board, terminal, conflict), of a record's start_code, start_location, start_device,
    start_terminal_board, start_terminal and those of its nested start: location, device, terminal_board, terminal.

    White space goes and letters are upper case. A code or nested device that begins with + is a location; a terminal
    `board:pin` is split at its last colon; a board that contradicts it is a conflict, and then nothing else counts."""

    named = {name: F.nullif(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), F.lit("")) for name, c in r.items() if name in START_FIELDS}
    made = start_split(start_parts(named))
    return F.struct(*[made[name].alias(name) for name in START])


def start_identities(df: DataFrame, starts: dict[str, dict[str, Column]]) -> DataFrame:
    """`df` with a `start_identity` per name. Each step's columns are read by name by the next: put into one another, the patterns would be
    searched again wherever a column is used, in an expression too large to compile."""
    kept = df.columns
    said = lambda c: F.nullif(F.col(c), F.lit(""))
    place = lambda name, part: f"__{name}_{part}"
    text = {place(n, f): F.upper(F.regexp_replace(c, r"(?U)\s+", "")) for n, r in starts.items() for f, c in r.items() if f in START_FIELDS}
    df = df.withColumns(text)
    parts = {n: start_parts({f: said(place(n, f)) for f in r if f in START_FIELDS}) for n, r in starts.items()}
    df = df.withColumns({place(n, f"has_{part}"): c for n, made in parts.items() for part, c in made.items()})
    split = {n: start_split({part: F.col(place(n, f"has_{part}")) for part in made}) for n, made in parts.items()}
    df = df.withColumns({place(n, f"is_{part}"): c for n, made in split.items() for part, c in made.items()})
    return df.select(*kept, *[F.struct(*[F.col(place(n, f"is_{part}")).alias(part) for part in START]).alias(n) for n in starts])


def start_parts(r: dict[str, Column]) -> dict[str, Column]:
    """Location, device, own board and terminal of a start from its cleaned fields."""
    said = lambda name: r.get(name, F.lit(None).cast("string"))
    unhyphened = lambda c: F.nullif(F.ltrim(c, F.lit("-")), F.lit(""))
    code, nested = said("start_code"), said("device")
    placed = lambda c: F.when(c.startswith("+"), c)
    location = F.coalesce(said("start_location"), said("location"), placed(code), placed(nested))
    part = lambda c: F.when(~c.startswith("+") & ~c.eqNullSafe(location), c)
    return {
        "location": location,
        "device": unhyphened(F.coalesce(said("start_device"), part(nested), part(code))),
        "own": unhyphened(F.coalesce(said("start_terminal_board"), said("terminal_board"))),
        "terminal": F.coalesce(said("start_terminal"), said("terminal")),
    }


def start_split(r: dict[str, Column]) -> dict[str, Column]:
    """The fields of START from those parts."""
    terminal, own = r["terminal"], r["own"]
    pin = F.substring_index(terminal, ":", -1)
    qualified = F.ltrim(F.substring(terminal, F.lit(1), F.char_length(terminal) - F.char_length(pin) - 1), F.lit("-"))
    split = F.coalesce(terminal.contains(":"), F.lit(False))
    return {
        "location": r["location"],
        "device": r["device"],
        "board": F.when(split, F.nullif(qualified, F.lit(""))).otherwise(own),
        "terminal": F.when(split, F.nullif(pin, F.lit(""))).otherwise(terminal),
        "conflict": split & F.coalesce(own != qualified, F.lit(False)),
    }


def same_start(original: Column, scanned: Column) -> Column:
    """Whether two start identities are one: equal terminals, nothing that contradicts, a location that is known is known to
    both, and a device or a board in common; null where either is in conflict with itself."""
    both = lambda name: (original[name].isNotNull() & scanned[name].isNotNull())
    equal = lambda name: F.coalesce(original[name] == scanned[name], F.lit(False))
    against = lambda name: both(name) & ~equal(name)
    lost = original["location"].isNotNull() & scanned["location"].isNull()
    same = equal("terminal") & ~lost & ~against("location") & ~against("device") & ~against("board") & (equal("device") | equal("board"))
    return F.when(~original["conflict"] & ~scanned["conflict"], same)


def correction_route(issue: Column, cross_page: Column) -> Column:
    """Where a correction goes: (action, stages, calls), calls being the model calls to expect."""

    def plan(action: str, stages, calls) -> Column:
        named = F.array(*[F.lit(x) for x in stages]).cast("array<string>")
        return F.struct(F.lit(action).alias("action"), named.alias("stages"), F.lit(calls).cast("int").alias("calls"))

    at_home = cross_page == "same_page"
    route = F.when(at_home, plan("RERUN_STAGE_2", SCAN_STAGES, 1)).otherwise(plan("RERUN_STAGE_2", SCAN_STAGES, 2))
    pages = ("PAGE_CLASSIFICATION", *SCAN_STAGES)
    reclassify = F.when(at_home, plan("RERUN_STAGE_1", pages, 1)).otherwise(plan("RERUN_STAGE_1", pages, 2))
    route = F.when(issue == "PAGE_CLASSIFICATION_ERROR", reclassify).otherwise(route)
    for name, how in ROUTES.items():
        route = F.when(issue == name, plan(*how)).otherwise(route)
    return route


def full_terminal(terminal: Column, board: Column, device: Column) -> Column:
    """`board:pin` of an endpoint, or null: a supply's name alone is no terminal, and neither is a pin of nothing."""
    bare = lambda c: F.regexp_replace(F.trim(c), "^-", "")
    t = F.nullif(bare(F.nullif(terminal, F.lit(""))), F.lit(""))
    owner = F.coalesce(F.nullif(board, F.lit("")), F.nullif(device, F.lit("")))
    return F.when(t.contains(":"), t).when(~F.upper(t).isin(*SUPPLIES), F.concat(bare(owner), F.lit(":"), t))


def principle_number(start_marker: Column, end_marker: Column, unreadable: Column, start: Column, end: Column, sheet: Column) -> Column:
    """(number, rule, field, detail) of a connection: the digits read at a marker, else a full terminal, times the sheet; no
    terminal stands in for a marker that is there but unreadable. `field` and `detail` say why there is no number."""
    marked = F.coalesce(F.nullif(start_marker, F.lit("")), F.nullif(end_marker, F.lit("")))
    by_marker = F.when(F.coalesce(start_marker, F.lit("")) != "", "start_marker").otherwise("end_marker")
    fallback = marked.isNull() & ~unreadable
    selected = F.when(fallback, F.coalesce(start, end)).otherwise(marked)
    page = F.when(sheet != 0, sheet)
    why = lambda i: F.when(page.isNull(), NO_SHEET[i]).when(selected.isNotNull(), F.lit(None)).when(unreadable, UNREADABLE[i]).otherwise(NO_MARKER[i])
    return F.struct(
        F.concat(selected, page.cast("string")).alias("number"),
        F.when(fallback, "actual_terminal").otherwise(by_marker).alias("rule"),
        why(0).alias("field"),
        why(1).alias("detail"),
    )


def auto_select(recognised: Column, key: Column, status: Column, confidence: Column, least: float = 0.85) -> Column:
    """(status, detected, assigned, reason) of a detected profile; `status` is that of the registered profile `key`, null if there is none.
    What can't be assigned waits for the user, with the first reason that applies."""
    known = F.coalesce(recognised, F.lit(False)) & status.isNotNull()
    sure = confidence >= least
    chosen = known & sure & (status == "active")
    reason = (
        F.when(chosen, "model")
        .when(known & (status == "experimental"), "experimental")
        .when(known & ~sure, "low_confidence")
        .when((F.coalesce(key, F.lit("")) != "") & status.isNull(), "unregistered")
        .otherwise("model")
    )
    return F.struct(
        F.when(chosen, "PROFILE_SELECTED").otherwise("WAITING_INPUT").alias("status"),
        F.when(known, key).alias("detected"),
        F.when(chosen, key).alias("assigned"),
        reason.alias("reason"),
    )


def rescan_score(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """How well a new row fits an old one of its page. Both have id, page, no, and for start and end *_terminal, *_code and
    *_point (x, y, page). A kept id is 10000. Else 4 for the number, 2 for each equal end; 64 for a pin of the page that both have
    in any role, 16 more if its device is known and equal, unless devices contradict; 5 for points nearer than 0.025."""
    given = lambda c: F.nullif(c, F.lit(""))
    score = F.when(given(old["no"].cast("string")) == given(new["no"].cast("string")), 4).otherwise(0)
    anchors, near = [], F.lit(False)
    for a in ("start", "end"):
        score = score + F.when(given(old[f"{a}_terminal"]) == given(new[f"{a}_terminal"]), 2).otherwise(0)
        for b in ("start", "end"):
            x, y = given(old[f"{a}_code"]), given(new[f"{b}_code"])
            met = given(old[f"{a}_terminal"]) == given(new[f"{b}_terminal"])
            here = (old[f"{a}_point"]["page"] == old["page"]) & (new[f"{b}_point"]["page"] == new["page"])
            anchors.append(F.when(met & here & (x.isNull() | y.isNull() | (x == y)), F.when(x == y, 80).otherwise(64)).otherwise(0))
            p, q = old[f"{a}_point"], new[f"{b}_point"]
            near = near | F.coalesce((p["page"] == q["page"]) & (F.hypot(p["x"] - q["x"], p["y"] - q["y"]) < 0.025), F.lit(False))
    score = score + F.greatest(*anchors) + F.when(near, 5).otherwise(0)
    return F.when(old["page"] != new["page"], 0).when(given(old["id"].cast("string")) == given(new["id"].cast("string")), 10000).otherwise(score)
