"""Reports of cycles and comparisons: CSV, JSON, text and colour-coded XLSX.

All of them are a few dozen rows; Spark orders and shapes the rows, the driver renders them.
"""

from __future__ import annotations

import csv
import io
import json
import zipfile
from xml.sax.saxutils import escape

from tracewheel.sources.cycle_csv import cycle_csv_text

MICRO = "µs"

# Fill and font of each style of the sheets.
STYLES = {
    "header": ("4472C4", "FFFFFF", True),
    "exact": ("E2EFDA", None, False),
    "similar": ("DDEBF7", None, False),
    "removed": ("FFC7CE", None, False),
    "new_only": ("FFEB9C", None, False),
    "improved": ("00B050", "FFFFFF", True),
    "regressed": ("FF0000", "FFFFFF", True),
    "neutral": ("FFC000", None, True),
}
# Headers and widths of the columns A to L.
COLUMNS = (
    ("Baseline Kernel", 55), (f"Base Avg ({MICRO})", 12), ("Base Min", 12), ("Base Max", 12), ("Base StdDev", 12), ("New Kernel", 55),
    (f"New Avg ({MICRO})", 12), ("New Min", 12), ("New Max", 12), ("New StdDev", 12), ("Change (%)", 12), ("Match Type", 15),
)


def short(text: str, most: int) -> str:
    """At most ``most`` bytes, cut to dots."""
    raw = text.encode()
    return text if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "..."


def cycle_json_text(header: dict, rows: list[dict]) -> str:
    kernels = [{"name": r["name"], "total_dur_us": r["total_dur"], "min_dur_us": r["min_dur"], "max_dur_us": r["max_dur"], "avg_dur_us": r["avg_dur"], "stddev_us": r["stddev"], "count": r["cnt"], "index_in_cycle": r["index"]} for r in rows]
    return json.dumps({"cycle_length": header["cycle_len"], "num_cycles": header["reps"], "total_cycle_time_us": header["total_time"], "avg_cycle_time_us": header["avg_cycle_time"], "kernels": kernels}, indent=2, ensure_ascii=False) + "\n"


def cycle_summary_text(header: dict, top: list[dict], kinds: list[dict]) -> str:
    """``top``: rows by falling average; ``kinds``: (category, kernels, dur) by falling time."""
    mean, total = header["avg_cycle_time"] or 0.0, header["total_time"] or 0.0
    share = lambda d: d / mean * 100 if mean else 0.0
    out = ["", "=== Cycle Analysis Summary ===", f"Cycle Length: {header['cycle_len']} kernels", f"Number of Cycles: {header['reps']}", f"Average Cycle Time: {mean:.2f} {MICRO} ({mean / 1000:.4f} ms)", f"Total Measured Time: {total:.2f} {MICRO} ({total / 1000:.4f} ms)", "", "=== Top 10 Kernels by Average Duration ==="]
    for k, r in enumerate(top[:10], 1):
        out += [f"{k:2d}. [{r['index']:4d}] {short(r['name'], 80)}", f"          Avg: {r['avg_dur']:.2f} {MICRO} | Min: {r['min_dur']:.2f} | Max: {r['max_dur']:.2f} | StdDev: {r['stddev']:.2f}  ({share(r['avg_dur']):.2f}% of cycle)"]
    out += ["", "=== Kernel Type Distribution ==="]
    out += [f"  {r['category']:<20}: {r['kernels']:4d} kernels, {r['dur']:.2f} {MICRO} ({share(r['dur']):.1f}%)" for r in kinds]
    return "\n".join(out) + "\n"


def cycle_text(path: str, header: dict, rows: list[dict], kinds: list[dict]) -> str:
    """The report that the file's suffix asks for: JSON, CSV, or else text."""
    if path.endswith(".json"):
        return cycle_json_text(header, rows)
    if path.endswith(".csv"):
        return cycle_csv_text(header, rows)
    return cycle_summary_text(header, sorted(rows, key=lambda r: (-r["avg_dur"], r["index"])), kinds)


def compare_csv_text(matches: list[dict]) -> str:
    base, new, time = _sums(matches)[:3]
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(["eager_kernel", "compiled_kernel", "duration_us", "match_type"])
    w.writerow([f"Total ({base} eager kernels)", f"({new} compiled kernels)", f"{time:.3f}", ""])
    for m in matches:
        w.writerow([m["baseline"], m["new"], "" if m["new"] == "." else f"{m['new_avg']:.3f}", m["match_type"]])
    return out.getvalue()


def _sums(matches: list[dict]) -> tuple[int, int, float, float]:
    base, new = sum(m["match_type"] != "new_only" for m in matches), sum(m["match_type"] != "removed" for m in matches)
    return base, new, sum(m["new_avg"] for m in matches), sum(m["base_avg"] for m in matches)


def compare_summary_text(matches: list[dict], names: tuple[str, str] = ("baseline", "new")) -> str:
    base, new, time, _ = _sums(matches)
    share = lambda d: d / time * 100 if time > 0 else 0.0
    out = ["", "=== Trace Comparison Summary ===", f"Eager:    {names[0]} ({base} kernels/cycle)", f"Compiled: {names[1]} ({new} kernels/cycle)", "", f"Total Compiled Cycle Time: {time:.2f} {MICRO} ({time / 1000:.4f} ms)", "", "Match Types:"]
    kinds = sorted({m["match_type"] for m in matches})
    out += [f"  {k}: {sum(m['match_type'] == k for m in matches)}" for k in kinds] + ["", "=== Top 10 Kernels by Duration (Compiled) ==="]
    longest = sorted((m for m in matches if m["new_avg"] > 0), key=lambda m: (-m["new_avg"], m["ord"]))[:10]
    for k, m in enumerate(longest, 1):
        out += [f"{k:2d}. {m['new_avg']:.2f} {MICRO} ({share(m['new_avg']):.1f}%) - {m['match_type']}", f"    Compiled: {short(m['new'], 65)}", f"    Eager:    {short(m['baseline'], 65)}"]
    out += ["", "=== Fused/Removed Eager Kernels (no compiled equivalent) ==="]
    out += [f"  - {short(m['baseline'], 75)}" for m in matches if m["match_type"] == "removed"] or ["  (none)"]
    out += ["", "=== Compiled-Only Kernels (new fused kernels) ==="]
    out += [f"  {m['new_avg']:.2f} {MICRO} ({share(m['new_avg']):.1f}%) {short(m['new'], 60)}" for m in matches if m["match_type"] == "new_only"] or ["  (none)"]
    return "\n".join(out) + "\n"


def _cell(ref: str, value, style: int) -> str:
    if value is None:
        return f'<c r="{ref}" s="{style}"/>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}" s="{style}"><v>{value!r}</v></c>'
    return f'<c r="{ref}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def sheet_cells(matches: list[dict], info: dict) -> list[tuple[int, str, object, str]]:
    """(row, column letter, value, style) of every cell of a comparison's sheet; a value of None fills the cell only."""
    letters = "ABCDEFGHIJKL"
    base, new, new_sum, _ = _sums(matches)

    def said(side: str, n: int, reps, time: float) -> str:
        return f"{side}: {n} kernels" + (f" × {reps} iters" if reps else "") + (f", {time:.1f} {MICRO}/cycle" if time > 0 else "")

    base_time, new_time = info.get("base_cycle_time") or 0.0, info.get("new_cycle_time") or 0.0
    out: list[tuple[int, str, object, str]] = [(1, c, h, "header") for c, (h, _) in zip(letters, COLUMNS, strict=True)]
    out += [(2, "A", said("Baseline", base, info.get("base_reps"), base_time), ""), (2, "F", said("New", new, info.get("new_reps"), new_time), ""), (2, "G", round(new_sum, 3), "")]
    if base_time > 0 and new_time > 0:
        change = (new_time - base_time) / base_time * 100
        out.append((2, "K", round(change, 1), "improved" if change < -5 else "regressed" if change > 5 else "neutral"))
    for r, m in enumerate(matches, 3):
        has_base, has_new = m["base_avg"] > 0, m["new"] != "." and m["new_avg"] > 0
        line = [m["baseline"], *[round(m[f"base_{s}"], 3) if has_base else None for s in ("avg", "min", "max", "stddev")], m["new"], *[round(m[f"new_{s}"], 3) if has_new else None for s in ("avg", "min", "max", "stddev")]]
        out += [(r, c, v, m["match_type"]) for c, v in zip(letters, line, strict=False)]
        if m["change_pct"] is not None:
            out.append((r, "K", round(m["change_pct"], 1), m["change_class"]))
        elif m["match_type"] in ("new_only", "removed"):
            out.append((r, "K", "NEW" if m["match_type"] == "new_only" else "REMOVED", m["change_class"]))
        out.append((r, "L", m["match_type"], m["match_type"]))
    return out


def _sheet(matches: list[dict], info: dict) -> str:
    at = {"": 0} | {name: k for k, name in enumerate(STYLES, 1)}
    rows: dict[int, str] = {}
    for r, letter, value, style in sheet_cells(matches, info):
        rows[r] = rows.get(r, "") + _cell(f"{letter}{r}", value, at[style])
    widths = "".join(f'<col min="{k}" max="{k}" width="{w}" customWidth="1"/>' for k, (_, w) in enumerate(COLUMNS, 1))
    body = "".join(f'<row r="{k}">{cells}</row>' for k, cells in rows.items())
    return f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>{body}</sheetData><autoFilter ref="A1:L{len(rows)}"/></worksheet>'


_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"


def _styles() -> str:
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>' + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{f}"/></patternFill></fill>' for f, _, _ in STYLES.values())
    fonts = "<font/>" + "".join(f"<font>{'<b/>' if bold else ''}{f'<color rgb="FF{c}"/>' if c else ''}</font>" for _, c, bold in STYLES.values())
    formats = '<xf fontId="0" fillId="0"/>' + "".join(f'<xf fontId="{k}" fillId="{k + 1}" applyFont="1" applyFill="1"/>' for k in range(1, len(STYLES) + 1))
    n = len(STYLES)
    return f'<styleSheet xmlns="{_MAIN}"><fonts count="{n + 1}">{fonts}</fonts><fills count="{n + 2}">{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{n + 1}">{formats}</cellXfs></styleSheet>'


def write_compare_xlsx(path: str, sheets: list[tuple[str, list[dict], dict]]) -> None:
    """A workbook with one sheet a comparison: (name, matches in order, info of both cycles)."""
    if not sheets:
        raise ValueError("no comparisons to write")
    names = []
    for name, _, _ in sheets:
        clean = "".join("_" if c in "[]:*?/\\" else c for c in name)[:31]
        names.append(clean if clean not in names else f"{clean[:27]}_{len(names)}")
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><bookViews><workbookView activeTab="0"/></bookViews><sheets>{"".join(f"""<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>""" for k, n in enumerate(names, 1))}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships">{"".join(f"""<Relationship Id="rId{k}" Type="{_REL}/worksheet" Target="worksheets/sheet{k}.xml"/>""" for k in range(1, len(sheets) + 1))}<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _styles(),
    } | {f"xl/worksheets/sheet{k}.xml": _sheet(m, info) for k, (_, m, info) in enumerate(sheets, 1)}
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, head + text)
