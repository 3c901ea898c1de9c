"""Self-contained HTML pages of aggregates. Spark does the counting; only short lists of labels and counts come here."""

from __future__ import annotations

import html
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywork.operators import triage

COLOURS = {"valid": "#2a7", "invalid_submission": "#c60", "no_submission": "#999", "timeout": "#36c", "oom": "#a3c", "crash": "#c33", "infra": "#ccc"}
STYLE = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{padding:2px 8px;border-bottom:1px solid #ddd;text-align:left}"
#: Cells of the dot grid and rows of the timeline at most; what is left out is counted on the page.
MAX_DOTS, MAX_ROWS = 2000, 30


def escape(x) -> str:
    return html.escape("" if x is None else str(x), quote=True)


def duration(seconds: float) -> str:
    return f"{seconds:.0f}s" if seconds < 90 else f"{seconds / 60:.0f}m" if seconds < 5400 else f"{seconds / 3600:.1f}h"


def ticks(top: float, n: int = 5) -> list[float]:
    """Round numbers from 0 to top, in steps of 1, 2 or 5 times a power of ten."""
    if top <= 0:
        return [0.0]
    power = 10 ** math.floor(math.log10(top / n))
    step = next(s * power for s in (1, 2, 5, 10) if top / (s * power) <= n)
    return [round(k * step, 10) for k in range(int(top / step) + 1)]


def table(head: list[str], rows: list[list]) -> str:
    cells = lambda tag, row: "".join(f"<{tag}>{escape(x)}</{tag}>" for x in row)
    return f"<table><tr>{cells('th', head)}</tr>" + "".join(f"<tr>{cells('td', r)}</tr>" for r in rows) + "</table>"


def bars(counts: list[tuple[str, int]]) -> str:
    total, x, out = sum(n for _, n in counts) or 1, 0.0, []
    for name, n in counts:
        w = 600 * n / total
        out.append(f'<rect x="{x:.1f}" y="0" width="{w:.1f}" height="24" fill="{COLOURS.get(name, "#888")}"><title>{escape(name)}: {n}</title></rect>')
        x += w
    return f'<svg width="600" height="24">{"".join(out)}</svg>'


def dots(cells: list[tuple]) -> str:
    items, seeds = sorted({c[0] for c in cells}), sorted({c[1] for c in cells})
    at = {(i, s): o for i, s, o in cells}
    out = [f'<circle cx="{20 + 18 * seeds.index(s)}" cy="{14 + 18 * items.index(i)}" r="6" fill="{COLOURS.get(at[i, s], "#fff")}"><title>{escape(i)} seed {escape(s)}: {escape(at[i, s])}</title></circle>' for i, s in at]
    return f'<svg width="{40 + 18 * len(seeds)}" height="{20 + 18 * len(items)}">{"".join(out)}</svg>'


def timeline(rows: list[tuple[str, float]], top: float) -> str:
    out = [f'<line x1="{500 * t / top:.1f}" x2="{500 * t / top:.1f}" y1="0" y2="{14 * len(rows)}" stroke="#ddd"><title>{duration(t)}</title></line>' for t in ticks(top)]
    out += [f'<rect x="0" y="{14 * k}" width="{500 * min(t, top) / top:.1f}" height="10" fill="#69b"><title>{escape(name)}: {duration(t)}</title></rect>' for k, (name, t) in enumerate(rows)]
    return f'<svg width="520" height="{14 * len(rows) + 4}">{"".join(out)}</svg>'


def report(triaged: DataFrame, title: str = "Runs") -> str:
    """The page of a run group (run, item, seed, outcome, signal, wall_clock, time_cap, exit_code)."""
    counts = [(r["outcome"], r["n"]) for r in triage.counts(triaged).orderBy("ord").collect()]
    total, infra = sum(n for _, n in counts), dict(counts)["infra"]
    cells = [tuple(r) for r in triaged.groupBy("item", "seed").agg(F.max_by("outcome", "run").alias("outcome")).orderBy("item", "seed").limit(MAX_DOTS).collect()]
    longest = triaged.orderBy(F.desc("wall_clock"), "item", "seed").select("run", "wall_clock", "outcome", "signal").limit(MAX_ROWS).collect()
    room = triage.headroom(triaged).first()
    left = f"<p>{total - len(longest)} more runs are not listed.</p>" if total > len(longest) else ""
    body = [f"<h1>{escape(title)}</h1><p>{total} runs, {total - infra} gradeable.</p>", bars(counts), table(["outcome", "runs"], [list(c) for c in counts]), dots(cells), timeline([(r["run"], r["wall_clock"] or 0.0) for r in longest], room["max_time"]), table(["run", "time", "outcome", "signal"], [[r["run"], duration(r["wall_clock"] or 0.0), r["outcome"], r["signal"]] for r in longest]), left]
    return page(title, body)


def fill(delta: float | None, significant: bool) -> str:
    """Colour of a skill cell: neutral unless significant, then by size."""
    if delta is None or not significant:
        return "#eee"
    strength = sum(abs(delta) >= x for x in (0.02, 0.05, 0.20))
    return (("#fee", "#fbb", "#f88", "#e44") if delta < 0 else ("#efe", "#bfb", "#8d8", "#4b4"))[strength]


def matrix(cells: list[tuple]) -> str:
    """Agents down, items and their seeds across: (agent, item, seed, outcome, score, medal); what didn't run is a small dot."""
    agents, items, seeds = (sorted({c[k] for c in cells}) for k in (0, 1, 2))
    at, out = {c[:3]: c[3:] for c in cells}, []
    for y, agent in enumerate(agents):
        out.append(f'<text x="0" y="{44 + 18 * y}">{escape(agent)}</text>')
        for x, (item, seed) in enumerate((i, s) for i in items for s in seeds):
            outcome, score, medal = at.get((agent, item, seed), (None, None, None))
            said = f"{agent}, {item}, seed {seed}: {outcome or 'not run'}" + (f", score {score:.4f}" if score is not None else "") + (f", {medal}" if medal else "")
            out.append(f'<circle cx="{150 + 18 * x + 10 * (x // len(seeds))}" cy="{40 + 18 * y}" r="{6 if outcome else 1.5}" fill="{COLOURS.get(outcome, "#bbb")}"><title>{escape(said)}</title></circle>')
    out += [f'<text x="{144 + (18 * len(seeds) + 10) * k}" y="20">{escape(item)}</text>' for k, item in enumerate(items)]
    return f'<svg width="{170 + (18 * len(seeds) + 10) * len(items)}" height="{50 + 18 * len(agents)}">{"".join(out)}</svg>'


def meters(rows: list[tuple]) -> str:
    """One bar an item: the share of the leaderboard that the best agent beats, and where gold begins: (item, share, gold share)."""
    out = []
    for k, (item, share, gold) in enumerate(rows):
        y = 24 * k
        out.append(f'<text x="0" y="{y + 14}">{escape(item)}</text><rect x="150" y="{y + 3}" width="300" height="14" fill="#eee"/><rect x="150" y="{y + 3}" width="{max(300 * share, 2):.1f}" height="14" fill="#2a7"><title>{escape(item)}: beats {share:.0%}</title></rect><text x="458" y="{y + 14}">{share:.0%}</text>')
        out += [f'<line x1="{150 + 300 * gold:.1f}" x2="{150 + 300 * gold:.1f}" y1="{y}" y2="{y + 20}" stroke="#000"><title>gold</title></line>'] if gold is not None else []
    return f'<svg width="510" height="{24 * len(rows) + 4}">{"".join(out)}</svg>'


def dashboard(standings: DataFrame, skills: DataFrame | None = None, title: str = "Agents", outcomes: DataFrame | None = None, reached: DataFrame | None = None) -> str:
    """The page of several agents: standings (subject, medal_rate, mean_percentile, valid_rate, place) and skill cells.

    outcomes (subject, item, seed, outcome, score, medal) adds the matrix of all runs, reached (subject, item, percentile, gold)
    the room that is left to the best agent on each item; items without a percentile aren't shown.
    """
    rows = standings.orderBy("place").limit(MAX_ROWS).collect()
    body = [f"<h1>{escape(title)}</h1>", table(["place", "agent", "medal rate", "percentile", "valid"], [[r["place"], r["subject"], f"{r['medal_rate']:.1%}", "-" if r["mean_percentile"] is None else f"{r['mean_percentile']:.1%}", f"{r['valid_rate']:.1%}"] for r in rows])]
    if outcomes is not None:
        cells = [tuple(r) for r in outcomes.select("subject", "item", "seed", "outcome", "score", "medal").orderBy("subject", "item", "seed").limit(MAX_DOTS).collect()]
        total = outcomes.count()
        body.append((matrix(cells) if cells else "<p>No runs.</p>") + (f"<p>{total - len(cells)} more runs are not drawn.</p>" if total > len(cells) else ""))
    if reached is not None and rows:
        best = reached.where((F.col("subject") == rows[0]["subject"]) & F.col("percentile").isNotNull()).groupBy("item").agg(F.avg("percentile").alias("p"), F.max("gold").alias("g")).orderBy("item").limit(MAX_DOTS).collect()
        body.append(meters([tuple(r) for r in best]) if best else "")
    if skills is not None:
        cells = skills.orderBy("agent", "challenge").limit(MAX_DOTS).collect()
        body.append("<table>" + "".join(f'<tr><td>{escape(c["agent"])}</td><td>{escape(c["challenge"])}</td><td style="background:{fill(c["delta"], c["significant"])}">{"broke" if c["broke"] else "-" if c["delta"] is None else f"{c["delta"]:+.3f}"}</td></tr>' for c in cells) + "</table>")
    return page(title, body)


def page(title: str, body: list[str]) -> str:
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style></head><body>{"".join(body)}</body></html>'
