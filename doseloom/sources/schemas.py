"""Fixed read schemas; nothing is inferred from the data."""

from __future__ import annotations

SCORING_FILE = {"hm_chr": "string", "hm_pos": "int", "effect_allele": "string",
                "other_allele": "string", "effect_weight": "double"}
WEIGHT_CSV = "chr string, bp int, effect_allele string, weight double"
PREPARED_WEIGHTS = WEIGHT_CSV + ", contig string, position int"
PROCESSED_WEIGHTS = "chr string, pos int, effect_allele string, weight double, id string"
FLAGGED_SAMPLES = "sample_id string"
PERSON_IDS = "person_id string"
INTERVALS = "contig string, start int, end int"
SCORES = "s string, total_score double, variant_count bigint, normalized_score double"
VARIANTS = "contig string, position int, alleles array<string>"
SAMPLES = "s string"
CALLS = VARIANTS + ", s string, gt array<int>, ft boolean"
LAYOUT = "block_size int, folder_blocks int"
ALIGNMENT = ("name string, path struct<mapping: array<struct<"
             "position: struct<node_id: string>>>>")

PERSON = ("person_id long, gender_concept_id long, birth_datetime timestamp, race_concept_id long, "
          "ethnicity_concept_id long, sex_at_birth_concept_id long")
CONCEPT = "concept_id long, concept_name string"
SEARCH_PERSON = "person_id long, has_ehr_data int, has_whole_genome_variant int"
SEARCH_EVENTS = ("person_id long, entry_date date, concept_id long, is_standard int, "
                 "value_source_concept_id long")
CRITERIA = ("id long, concept_id long, domain_id string, type string, subtype string, path string, "
            "full_text string, is_standard int, is_selectable int")
CONDITIONS = "person_id long, condition_source_value string"
SURVEY = ("person_id long, survey_datetime timestamp, survey string, question_concept_id long, "
          "question string, answer_concept_id long, answer string, "
          "survey_version_concept_id long, survey_version_name string")

WAREHOUSE = {"person": PERSON, "concept": CONCEPT, "cb_search_person": SEARCH_PERSON,
             "cb_search_all_events": SEARCH_EVENTS, "cb_criteria": CRITERIA,
             "condition_occurrence": CONDITIONS, "ds_survey": SURVEY}
