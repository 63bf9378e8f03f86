"""Reports of a few rows, rendered on the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

EXPLANATIONS = {
    "field_accuracy": "Share of golden characteristics found in the card.",
    "citation_hit": "Share of probe texts that the cited chunks contain.",
    "faithfulness": "Share of the card's statements that the judge found confirmed.",
}


def evaluation_report(scores: DataFrame, averages: DataFrame) -> str:
    """JSON of the golden-set scores by file, their averages and the weakest metric."""
    report = {r["file"]: {k: v for k, v in r.asDict(True).items() if k != "file"} for r in scores.collect()}
    row = averages.collect()[0].asDict()
    weakest = row.pop("weakest_metric")
    report["averages"] = row
    report["weakest_metric"] = None
    if row["documents"]:
        report["weakest_metric"] = {
            "name": weakest,
            "value": row[weakest],
            "explanation": EXPLANATIONS[weakest],
        }
    return json.dumps(report, ensure_ascii=False, indent=2, default=str)


def threshold_report(
    hybrid: DataFrame, vector: DataFrame, foreign: DataFrame, recommendation: DataFrame
) -> str:
    """Markdown of a threshold measurement."""
    lines = ["# Retrieval threshold", "", "## Hybrid", "", "| threshold | purity | in family | fully pure |"]
    lines.append("| ---: | ---: | ---: | ---: |")
    for r in hybrid.orderBy("threshold").collect():
        lines.append(f"| {r['threshold']} | {r['purity']:.2f} | {r['in_family']:.2f} | {100 * r['full_share']:.0f} % |")
    lines += ["", "## Vector leg only", "", "| threshold | purity |", "| ---: | ---: |"]
    lines += [f"| {r['threshold']} | {r['purity']:.2f} |" for r in vector.orderBy("threshold").collect()]
    first = foreign.collect()[0]
    if first["rank_median"] is not None:
        lines += [
            "",
            f"First chunk of another family: rank {first['rank_median']} (median; {first['rank_min']} to "
            f"{first['rank_max']}), cosine {first['cosine_median']:.3f} ({first['cosine_min']:.3f} to {first['cosine_max']:.3f}).",
        ]
    best = recommendation.collect()[0]
    lines += ["", f"Recommended: {best['best']} (plateau {best['plateau_min']} to {best['plateau_max']}).", ""]
    return "\n".join(lines)
