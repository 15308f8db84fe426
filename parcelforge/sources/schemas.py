"""Table schemas of the property store. Money, places and scores are doubles, counts and years bigint, ids and codes text."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "assessments_records": "record_id string, source_id string, location_id string, year bigint, value double, confidence double, lat double, lon double, reason_code string, raw_json string",
    "property_locations": "location_id string, neighbourhood string, neighbourhood_id bigint, ward string, zoning string, tax_class string, garage string, suite string, house string, street string, lot_size double, gross_area double, year_built bigint, value double, lat double, lon double, source_ids array<string>, updated_at timestamp",
    "property_attributes": "location_id string, bedrooms bigint, bathrooms double, bedrooms_estimated bigint, bathrooms_estimated double, source_type string, confidence double, quarantined boolean",
    "geospatial": "dataset_type string, entity_id string, source_id string, name string, category string, lat double, lon double, geometry string",
    "roads": "road_id string, source_id string, name string, category string, surface string, geometry string",
    "road_segments": "segment_id string, road_id string, source_id string, name string, points array<struct<lat:double,lon:double>>, metres double",
    "pois": "poi_id string, name string, category string, subcategory string, address string, lat double, lon double, sources map<string,string>",
    "census": "area_id string, geography_level string, population bigint, households bigint, area_km2 double, density double, income double, limited_accuracy int",
    "crime_summary": "source_id string, neighbourhood string, crime_type string, year bigint, incidents double, rate double",
    "transit": "transit_type string, entity_id string, source_id string, name string, lat double, lon double, points array<struct<lat:double,lon:double>>",
    "canonical_links": "canonical_id string, source_id string, entity_id string, confidence double, decision string",
    "run_logs": "run_id string, pipeline string, status string, started_at timestamp, finished_at timestamp, counts map<string,bigint>, warnings array<string>",
    "dataset_versions": "dataset string, version_id string, promoted_at timestamp",
    "alerts": "run_id string, level string, message string, at timestamp",
    "grid_features": "grid_id string, property_count bigint, mean_value double, median_value double, store_density double, store_types string, walkability double, park_density double, crime_rate_index double, crime_severity_index double, school_distance double, flagged boolean",
    "neighbourhood_model": "neighbourhood string, average_value double, median_value double, property_count bigint, centroid_lat double, centroid_lon double, flagged boolean",
}
