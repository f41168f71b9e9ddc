"""A Markdown report of the tables behind the analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Sections in order; the last two need accidents.
SECTIONS = ["Slope and Level of Traffic Stress", "Exploratory Spatial Data Analysis", "Cluster Analysis", "Network Analysis", "Gap Analysis", "Destination Access Analysis", "Accident Analysis", "Sum-Up Analysis"]
NEED_ACCIDENTS = {"Accident Analysis", "Sum-Up Analysis"}


def markdown(city: str, tables: dict[str, dict[str, DataFrame]], accidents: bool, rows: int = 20) -> str:
    """``tables``: section -> title -> table, of which the first ``rows`` are shown."""
    lines = [f"# {city}: level of traffic stress and cycling network", ""]
    shown = [s for s in SECTIONS if accidents or s not in NEED_ACCIDENTS]
    for number, section in enumerate(shown, 1):
        lines += [f"## Section {number}: {section}", ""]
        for title, df in tables.get(section, {}).items():
            lines += [f"### {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
            lines += ["| " + " | ".join(str(x) for x in r) + " |" for r in df.limit(rows).collect()] + [""]
    return "\n".join(lines)
