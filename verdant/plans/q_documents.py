"""Registered query of the consolidated documents (S8); they are made of other queries' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.functions import semantics as S
from verdant.operators import documents as DOC
from verdant.plans import q_features, q_prescription, q_rollup, q_sources  # noqa: F401  register what the documents hold
from verdant.plans.registry import ORACLES, QUERIES, query
from verdant.session import output_path

# Document -> sections: name, registered query, key, numeric fields, text fields.
DOCUMENTS = {
    "national_analysis": [
        ("summary", "national_summary", None, ["total_regions_analyzed", "successful_analyses", "critical_count", "warning_count", "normal_count", "average_alert_score"], ["overall_status", "high_risk_regions"]),
        ("statistics", "national_score_stats", None, ["median_alert_score", "max_alert_score", "regions_requiring_attention", "success_rate"], ["data_completeness"]),
        ("provinces", "province_breakdown", "province", ["critical", "warning", "normal", "total"], [])],
    "alerts_consolidated": [
        ("distribution", "alert_summary", None, ["total_alerts", "critical_alerts", "warning_alerts", "normal_alerts", "error_alerts"], []),
        ("regional_alerts", "success_only", "region_id", ["alert_score"], ["alert_level"])],
    "satellite_data": [
        ("vegetation_summary", "vegetation_rollup", None, ["total_regions", "avg_ndvi", "min_ndvi", "max_ndvi", "avg_ndwi"], []),
        ("regions", "vegetation_by_region", "series_id", ["data_points", "latest_NDVI", "latest_NDWI_Gao", "avg_NDVI", "avg_NDWI_Gao"], [])],
    "weather_soil_data": [
        ("climate_summary", "climate_rollup", None, ["total_regions", "avg_temperature", "min_temperature", "max_temperature", "total_precipitation"], []),
        ("weather_data", "climate_by_region", "series_id", ["data_points", "latest_T2M", "latest_PRECTOTCORR", "avg_T2M"], []),
        ("soil_data", "soil_root_summary", "location_id", ["sand_weighted_avg", "clay_weighted_avg", "awc_weighted_avg", "ksat_weighted_avg"], ["surface_texture"])],
    "prescription_maps": [
        ("national_irrigation_summary", "irrigation_rollup", None, ["avg_irrigation_rate", "total_regions_requiring_irrigation", "max_irrigation_rate", "total_water_requirement_estimate"], []),
        ("regional_prescriptions", "prescription_summary", "region_id", ["average_irrigation_rate", "maximum_irrigation_rate", "zones_present", "irrigation_uniformity_coefficient"], [])],
}


def _sql() -> str:
    parts = []
    for document, sections in DOCUMENTS.items():
        for section, name, key, numbers, texts in sections:
            for c in numbers + texts:
                k, number, text = f"CAST({key or 'NULL'} AS VARCHAR)", f"CAST({c if c in numbers else 'NULL'} AS DOUBLE)", f"CAST({c if c in texts else 'NULL'} AS VARCHAR)"
                parts.append(f"SELECT '{document}' AS document, '{section}' AS section, {k} AS key, '{c}' AS name, {number} AS number, {text} AS text FROM ({ORACLES[name]}) WHERE {c} IS NOT NULL")
    return "SELECT document, section, key, name, round(number, 6) AS number, text FROM (" + " UNION ALL ".join(parts) + ")"


@query("consolidated_documents", _sql())
def q_consolidated_documents(spark, sf):
    """Writes the five documents of a run, and reads every field back."""
    made, numeric = {}, []
    for document, sections in DOCUMENTS.items():
        numeric += [f"{document}/{section}/{c}" for section, _, _, numbers, _ in sections for c in numbers]
        made[document] = [DOC.lines(section, QUERIES[name](spark, sf).select(*([key] if key else []), *numbers, *texts), key) for section, name, key, numbers, texts in sections]
    path = DOC.write_documents(made, output_path(spark, "documents"), "1998-01-01")
    told = None
    for document in made:
        rows = DOC.fields(DOC.read_document(spark, path, document))
        told = rows if told is None else told.unionByName(rows)
    number = F.concat_ws("/", "document", "section", "name").isin(numeric)
    return told.select("document", "section", "key", "name", S.rnd(F.when(number, F.col("value").cast("double")), 6).alias("number"), F.when(~number, F.col("value")).alias("text"))
