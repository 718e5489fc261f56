"""Reports of small, already ranked results as text and HTML."""
from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import top_n

NOTE = "A score says what to look at first. It is never a verdict about a person."


def bar(value: float, width: int = 20) -> str:
    full = round(max(0.0, min(1.0, value)) * width)
    return "#" * full + "." * (width - full)


def ranked(observations: DataFrame) -> DataFrame:
    """Observations as they are reported: rounded, the highest score first."""
    entry = F.transform_values("signals", lambda k, v: F.struct(F.bround(v["value"], 3).alias("value"), v["samples"].alias("samples"), v["confident"].alias("confident"), v["raw"].alias("raw")))
    return observations.select("match_id", "steamid", "name", "team", "kills", "deaths", "headshots", "shots", F.bround("hs_pct", 1).alias("hs_pct"), F.bround("score", 1).alias("score"), entry.alias("signals"), "flags", F.slice("evidence", 1, 6).alias("evidence")).orderBy(F.desc("score"), "match_id", "steamid")


def index(observations: DataFrame, n: int = 3) -> DataFrame:
    """The first n players of each match."""
    return top_n(observations, ["match_id"], [F.desc("score"), F.col("steamid")], n).select("match_id", "steamid", "name", "score")


def write_json(observations: DataFrame, path: str) -> None:
    ranked(observations).write.mode("overwrite").json(path)


def text(observations: DataFrame, limit: int = 10) -> str:
    """A terminal report of the first players."""
    lines = [NOTE, ""]
    for r in ranked(observations).limit(limit).collect():  # a report's length
        strong = sorted(((v.value, k) for k, v in r.signals.items() if v.value >= 0.3), reverse=True)[:2] if r.signals else []
        lines.append(f"{r.score:5.1f} {bar(r.score / 100)} {r.name[:24]:24} {r.kills}/{r.deaths} hs {r.hs_pct:.0f}%  {', '.join(k for _, k in strong)}")
        lines += [f"      round {e['round']} tick {e.tick}: {e.detail} {e.target}" for e in (r.evidence or [])[:3]]
    return "\n".join(lines)


def html(observations: DataFrame, title: str = "Report", limit: int = 100) -> str:
    """One page; whatever comes from the data is escaped."""
    rows = []
    for r in ranked(observations).limit(limit).collect():  # a page's length
        kind = "high" if r.score >= 55 else "middle" if r.score >= 35 else "low"
        shown = "".join(f"<li>round {e['round']}, tick {e.tick}: {escape(e.detail)} {escape(e.target)}</li>" for e in r.evidence or [])
        rows.append(f'<tr class="{kind}"><td>{r.score:.1f}</td><td>{escape(r.name)}</td><td>{r.steamid}</td><td>{escape(", ".join(r.flags or []))}</td><td><ul>{shown}</ul></td></tr>')
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><p>{NOTE}</p><table>{''.join(rows)}</table>"
