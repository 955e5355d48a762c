"""The brief as Markdown, JSON and HTML. Text only: no session, clock or file."""

from __future__ import annotations

import html as _html
import json
from collections.abc import Callable, Iterable, Sequence

from weftline.operators.report import Report

_ROLES = (
    ("orchestrator", "Orchestrators", "high inclusive cost, ~0 self: the callees are what to optimise", "neutral"),
    ("hidden hotspot", "Hidden hotspots", "hot with few callers: a review easily misses them", "warn"),
    ("aligned core", "Aligned core", "much depended upon and hot: genuine hotspots", "ok"),
)
_NO_CALLS = "No call edges: run `extract --semantic`."


def permalink(provenance: dict | None, symbol: dict) -> str | None:
    """The symbol's line on the hosting site; None for a graph of unknown origin."""
    if provenance is None:
        return None
    return f"{provenance['baseUrl']}/blob/{provenance['commit']}/{provenance['prefix']}{symbol['file_path']}#L{symbol['start_line']}"


def percent(share: float, digits: int = 0) -> str:
    return f"{share * 100:.{digits}f}%"


def number(value: float) -> str:
    """A whole number without its fraction."""
    return str(int(value)) if float(value).is_integer() else repr(float(value))


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(x.title() for x in rest)


def _symbol(row: dict, *more: str) -> dict:
    return {_camel(k): row[k] for k in ("name", "kind", "file_path", "start_line", *more)}


def as_dict(report: Report) -> dict:
    """The report with the keys of its JSON form."""
    t = report.tables
    boundary = {_camel(k): [_symbol(r) for r in t["boundary"] if r["kind"] == kind] for k, kind in (("endpoints", "Endpoint"), ("config_flags", "ConfigFlag"), ("external_apis", "ExternalAPI"))}
    roles = {key: [_symbol(r) for r in t["structure"] if r["role"] == role] for key, role in (("orchestrators", "orchestrator"), ("hiddenHotspots", "hidden hotspot"), ("alignedCore", "aligned core"))}
    return {
        "generatedAt": report.generated_at, "project": report.project, "outputFolder": report.output_folder, "provenance": report.provenance, "semantic": report.semantic, "enriched": report.enriched,
        "coverage": report.coverage, "totalSelf": report.total_self, "limit": report.limit, "totals": {_camel(k): v for k, v in report.totals.items()}, "verdict": report.verdict,
        "nodeKinds": t["node_kinds"], "edgeKinds": t["edge_kinds"], "hubsByCallers": [_symbol(r, "score") for r in t["callers"]], "hubsByBlastRadius": [_symbol(r, "score") for r in t["blast"]],
        "communityQuality": report.quality, "communities": t["communities"], "hotspots": [_symbol(r, "score") for r in t["hotspots"]],
        "cost": [_symbol(r, "self_cost", "inclusive_cost", "share_of_total", "cyclic") | {"cycleSize": r["component_size"]} for r in t["cost"]],
        "structureVsRuntime": roles, "cycles": [{"size": c["size"], "members": [_symbol(m) for m in c["symbols"]]} for c in t["cycles"]], "boundary": boundary, "deadExports": [_symbol(r) for r in t["dead"]],
        "keyFindings": [{**f, "symbols": [_symbol(s) for s in f["symbols"]]} for f in report.findings],
    }


def to_json(report: Report) -> str:
    return json.dumps(as_dict(report), indent=2, ensure_ascii=False)


def _table(head: Sequence[str], rows: Iterable[Sequence[str]], right: Sequence[int] = ()) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    rule = line(["---:" if k in right else "---" for k in range(len(head))])
    return [line(head), rule, *(line([c.replace("|", "\\|") for c in row]) for row in rows)]


def markdown(report: Report) -> str:
    r, t, origin = report, report.tables, report.provenance

    def code(row: dict) -> str:
        return f"`{row['name']}`"

    def linked(label: str, row: dict) -> str:
        url = permalink(origin, row)
        return f"[{label}]({url})" if url else label

    def place(row: dict) -> str:
        return linked(f"`{row['file_path']}:{row['start_line']}`", row)

    def ranked(rows: list[dict], score: str) -> list[str]:
        return _table(["Symbol", score, "Location"], [[code(x), number(x["score"]), place(x)] for x in rows], [1]) if rows else [f"_{_NO_CALLS}_"]

    def kinds(rows: list[dict]) -> list[str]:
        return _table(["Kind", "Count"], [[f"`{x['kind']}`", str(x["count"])] for x in rows], [1]) if rows else ["_(none)_"]

    def finding(f: dict) -> str:
        about = ", ".join(linked(code(s), s) for s in f["symbols"])
        return f"- **{f['title']}:** {about} — {f['detail']}" if about else f"- **{f['title']}** — {f['detail']}"

    origin_line = " · ".join([*([f"`{origin['prefix']}`"] if origin and origin["prefix"] else []), *([f"commit `{origin['commit'][:7]}`"] if origin else []), f"generated {r.generated_at}"])
    banner = f"**semantic {'✓' if r.semantic else '—'} · enriched {'✓' if r.enriched else '—'}" + ("" if r.coverage is None else f" · runtime coverage {percent(r.coverage)}") + "**"
    quality = "" if r.quality is None else f" (quality {r.quality:.2f})"
    n = r.totals
    snapshot = f"{n['symbols']} symbols · {n['files']} files · {n['relationships']} relationships · {n['communities']} communities{quality} · {n['dead_exports']} dead exports · {n['cycles']} cycles"
    runtime = ["_Run `enrich` to populate hotspots, cost and structure against runtime._"]
    if r.enriched:
        hot = _table(["Symbol", "Self-time (ms)", "Location"], [[code(x), f"{x['score']:.1f}", place(x)] for x in t["hotspots"]], [1])
        cost = _table(["Symbol", "Inclusive (ms)", "Share", "Location"], [[code(x) + (" ↺" if x["cyclic"] else ""), f"{x['inclusive_cost']:.1f}", percent(x["share_of_total"], 1), place(x)] for x in t["cost"]], [1, 2])
        runtime = ["**Hotspots** — exclusive self-time", "", *hot, "", "**Cost** — inclusive, share of total runtime", "", *cost]
    edge = [(label, [x for x in t["boundary"] if x["kind"] == kind]) for label, kind in (("Endpoints", "Endpoint"), ("Configuration flags", "ConfigFlag"), ("External APIs", "ExternalAPI"))]
    boundary = [f"- **{label}** ({len(rows)}): {', '.join(map(code, rows))}" for label, rows in edge if rows]
    cycles = [f"- {c['size']}-symbol cycle: {', '.join(map(code, c['symbols']))}" for c in t["cycles"]]
    dead = ["Exported but never referenced:", "", *_table(["Symbol", "Kind", "Location"], [[code(x), x["kind"], place(x)] for x in t["dead"]])] if t["dead"] else ["_No dead exports._"]
    communities = _table(["Community", "Size"], [[x["label"], str(x["size"])] for x in t["communities"]], [1]) if t["communities"] else ["_No communities assigned: run `cluster` to populate them._"]
    parts = [
        ("Key findings", [finding(f) for f in r.findings] or ["_Nothing stands out: the sections below have the whole picture._"]),
        ("Snapshot", [snapshot]),
        ("Composition", ["**Symbols by kind**", "", *kinds(t["node_kinds"]), "", "**Relationships by kind**", "", *kinds(t["edge_kinds"])]),
        ("Load-bearing code", ["**Most depended-upon** — direct callers", "", *ranked(t["callers"], "Callers"), "", "**Largest blast radius** — symbols that a change can reach", "", *ranked(t["blast"], "Impacted")]),
        ("Communities", communities), ("Runtime", runtime),
    ]
    if r.enriched:
        parts.append(("Structure vs. runtime", [f"- **{title}** ({note}): {', '.join(code(x) for x in t['structure'] if x['role'] == role) or '—'}" for role, title, note, _ in _ROLES]))
    parts += [
        ("Cycles", cycles or ["_No call cycles detected: the call graph is acyclic._"]),
        ("System boundary", boundary or ["_No endpoints, configuration flags, or external API calls detected._"]),
        ("Cleanup candidates", dead), ("Where to go next", _next_steps(r)),
    ]
    lines = [f"# Codebase brief — {r.project}", "", origin_line, "", banner, "", f"> {r.verdict}", ""]
    for title, body in parts:
        lines += [f"## {title}", "", *body, ""]
    return "\n".join([*lines, "*Generated by weftline*", ""])


def _next_steps(r: Report) -> list[str]:
    run = lambda command: f"python -m weftline {command} -o {r.output_folder}"
    steps = []
    if r.enriched:
        steps += ["# where runtime is spent, and what is responsible for it", run("hotspots"), run("cost")]
    elif r.tables["blast"]:
        steps += ["# what to change with care", run("hotspots --by blast-radius")]
    if r.tables["dead"]:
        steps += ["# dead code to confirm before it is deleted", run("dead-exports")]
    lines = ["```sh", *steps, "# the whole graph for the viewer", run("webview"), "```"]
    hottest = r.enriched and bool(r.tables["hotspots"])
    focus = r.tables["hotspots"][:1] if hottest else r.tables["blast"][:1]
    if focus and (url := permalink(r.provenance, focus[0])):
        lines += ["", f"{'Hottest symbol' if r.enriched else 'Highest-impact symbol'}: [`{focus[0]['name']}`]({url})"]
    return lines


_STYLE = (
    "*{box-sizing:border-box}body{font:15px/1.5 system-ui,sans-serif;color:#1c1c1c;background:#fff;max-width:52rem;margin:0 auto;padding:2.5rem 2rem}h1{font-size:1.5rem;margin:0}h2{font-size:1rem;margin:1.8rem 0 .7rem;color:#555}"
    ".badge{display:inline-block;font-size:.8rem;padding:.2rem .6rem;border-radius:.4rem;margin-right:.4rem;background:#eee}.badge.ok{background:#dff3ea;color:#0b5f47}.verdict{background:#f2f2ee;border-radius:.6rem;padding:.8rem}"
    ".metrics,.svr-grid{display:flex;flex-wrap:wrap;gap:.6rem}.metric,.svr{background:#f2f2ee;border-radius:.5rem;padding:.6rem .9rem}.svr{flex:1;min-width:12rem}.metric b{display:block;font-size:1.3rem}"
    ".finding{border-left:3px solid #ccc;padding:.5rem .8rem;margin:.5rem 0;background:#fafaf7}.finding.risk{border-color:#b02a20}.finding.opportunity{border-color:#0b6b4f}"
    ".bar-row{display:flex;gap:.6rem;align-items:center;margin:.3rem 0}.bar-name{width:12rem;overflow:hidden;text-overflow:ellipsis;white-space:nowrap}.bar-track{flex:1;height:.55rem;background:#eee;border-radius:1rem}.bar-fill{display:block;height:100%;border-radius:1rem;background:#1f5f9f}"
    ".bar-val{width:5rem;text-align:right;color:#555}table{width:100%;border-collapse:collapse}td,th{text-align:left;padding:.3rem .5rem;border-bottom:1px solid #eee}footer{margin-top:2rem;color:#888;font-size:.8rem}"
)


def html(report: Report) -> str:
    """A page by itself, for printing: no script, no file beside it."""
    r, t = report, report.tables
    esc: Callable[[object], str] = lambda x: _html.escape(str(x), quote=True).replace("&#x27;", "'")
    names = lambda rows: " · ".join(esc(x["name"]) for x in rows)

    def section(title: str, body: str) -> str:
        return f"<section><h2>{esc(title)}</h2>{body}</section>" if body else ""

    def bar(label: str, value: str, share: float) -> str:
        return f'<div class="bar-row"><span class="bar-name">{esc(label)}</span><span class="bar-track"><span class="bar-fill" style="width:{min(1.0, max(0.0, share)) * 100:.1f}%"></span></span><span class="bar-val">{esc(value)}</span></div>'

    badges = "".join(f'<span class="badge {"ok" if on else "off"}">{name} {"✓" if on else "—"}</span>' for name, on in (("semantic", r.semantic), ("enriched", r.enriched)))
    badges += "" if r.coverage is None else f'<span class="badge info">coverage {percent(r.coverage)}</span>'
    where = " · ".join([*([r.provenance["baseUrl"].split("://", 1)[-1], f"commit {r.provenance['commit'][:7]}"] if r.provenance else []), f"generated {r.generated_at}"])
    metrics = "".join(f'<div class="metric">{k.replace("_", " ")}<b>{v}</b></div>' for k, v in r.totals.items())
    cards = "".join(f'<div class="finding {esc(f["tone"])}"><b>{esc(f["title"])}</b><div>{names(f["symbols"])}</div><div>{esc(f["detail"])}</div></div>' for f in r.findings)
    body = f'<header><h1>Codebase brief — {esc(r.project)}</h1><p>{esc(where)}</p><p>{badges}</p><p class="verdict">{esc(r.verdict)}</p></header><div class="metrics">{metrics}</div>' + section("Key findings", cards)
    if r.enriched:
        most = max((x["score"] for x in t["hotspots"]), default=0) or 1
        body += section("Inclusive cost, share of total runtime", "".join(bar(x["name"], percent(x["share_of_total"], 1), x["share_of_total"]) for x in t["cost"]))
        body += section("Self-time, exclusive milliseconds", "".join(bar(x["name"], f"{x['score']:.1f} ms", x["score"] / most) for x in t["hotspots"]))
        grid = "".join(f'<div class="svr {tone}"><b>{title}</b><div>{names([x for x in t["structure"] if x["role"] == role]) or "—"}</div><small>{esc(note)}</small></div>' for role, title, note, tone in _ROLES)
        body += section("Structure vs. runtime", f'<div class="svr-grid">{grid}</div>')
    rows = "".join(f"<tr><td>{esc(x['name'])}</td><td>{esc(x['kind'])}</td><td>{esc(x['file_path'])}:{x['start_line']}</td></tr>" for x in t["dead"])
    body += section("Dead exports", rows and f"<table><tr><th>Symbol</th><th>Kind</th><th>Location</th></tr>{rows}</table>")
    return f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>Codebase brief — {esc(r.project)}</title><style>{_STYLE}</style></head><body>{body}<footer>Generated by weftline</footer></body></html>\n'
