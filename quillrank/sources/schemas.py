"""Fixed schemas of the engine's tables."""

ITEM = "STRUCT<kind:STRING,name:STRING,description:STRING,importance:DOUBLE>"
RECORDS = f"custom_id STRING, occ_code STRING, batch_name STRING, style STRING, profile_type STRING, profile_text STRING, profile_dict MAP<STRING,{ITEM}>, counterfactual_key STRING, counterfactual_info STRING"
COMPLETIONS = "id STRING, model STRING, backend STRING, seed BIGINT, max_new_tokens BIGINT, max_chars BIGINT, n BIGINT, variant_id STRING, cv_id STRING, jd_id STRING, occ_code STRING, occ_title STRING, counterfactual STRING, counterfactual_info STRING, cv_batch STRING, cv_style STRING, jd_batch STRING, jd_style STRING, completion STRING"
SCORED_PAIRS = "cv_id STRING, jd_id STRING, occ_code STRING, counterfactual STRING, cv_style STRING, jd_style STRING, score DOUBLE, gt_score DOUBLE"
NODES = "doc_id STRING, pos INT, node_id STRING, type STRING, label STRING, evidence STRING, source_sentence STRING, source STRING, importance STRING"
EDGES = "doc_id STRING, source STRING, target STRING, relation STRING"
INSTANTIATIONS = "cv_id STRING, jd_id STRING, cv_node STRING, jd_node STRING, conf DOUBLE"
RUNS = "timestamp STRING, condition STRING, run_name STRING, job_id STRING, params MAP<STRING,STRING>"
EMPLOYMENT = "SOC_BASE STRING, TOT_EMP DOUBLE"
BATCH_RESULTS = "custom_id STRING, error STRUCT<message:STRING>, response STRUCT<status_code:INT, body:STRING>"
OCCUPATIONS = "code STRING, title STRING"
TRIPLES = "s STRING, p STRING, o STRING"
