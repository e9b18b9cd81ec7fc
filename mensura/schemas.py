"""Row types and closed vocabularies of the extraction data."""

#: The closed vocabularies of an extraction.
METRIC_TYPES = ("Bulk Concentration", "Individual Entity Concentration", "Process Metric", "Invalid Candidate")
ENTITY_TYPES = ("element", "element_group", "oxide", "mineral", "other")
MODIFIERS = ("none", "average", "approximate", "greater_than", "less_than", "up_to")
MASS_UNITS = ("%", "wt%", "ppm", "ppb", "g/t", "mg/kg", "kg/t", "ug/g", "permil")
SOLUTION_UNITS = ("mg/L", "g/L", "mol/L", "M")
UNITS = (*MASS_UNITS, *SOLUTION_UNITS, "dimensionless")
#: Spellings of units and what they stand for.
UNIT_ALIASES = {
    "wt.%": "wt%", "wt %": "wt%", "wt. %": "wt%", "%wt": "wt%", "weight%": "wt%", "wt-%": "wt%", "μg/g": "ug/g", "µg/g": "ug/g", "mcg/g": "ug/g",
    "mg/l": "mg/L", "g/l": "g/L", "mol/l": "mol/L", "‰": "permil", "per mil": "permil", "ppt": "permil", "g/tonne": "g/t", "gpt": "g/t", "ppmw": "ppm",
}
SPLITS = {"dev": "train", "val": "validation", "test": "test"}

#: An extraction's fields with their types.
EXTRACTION = {
    "value": "double", "value_max": "double", "is_range": "boolean", "unit": "string", "sentence": "string", "metric_type": "string", "target_entity": "string", "entity_type": "string", "context_modifier": "string",
}
#: The fields that make a pair complete (all but the sentence).
TUPLE_FIELDS = ("value", "value_max", "is_range", "unit", "metric_type", "target_entity", "entity_type", "context_modifier")
CATEGORICAL = ("metric_type", "entity_type", "context_modifier", "unit")

# Row types, as DDL.
WORK = (
    "id string, title string, display_name string, publication_year int, doi string, cited_by_count int, relevance_score double, open_access struct<is_oa: boolean>, "
    "abstract_inverted_index map<string, array<int>>, keywords array<struct<display_name: string, score: double>>, "
    "authorships array<struct<author: struct<display_name: string>>>, primary_location struct<source: struct<display_name: string>>"
)
_EXTRACTIONS = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in EXTRACTION.items()) + ">>"
GOLD = f"doc_id string, extracoes {_EXTRACTIONS}, particao string"
CANDIDATE = "doc_id string, titulo string, resumo string"
RESULT = {
    "doc_id": "string", "extracoes": _EXTRACTIONS, "rejeitadas": "array<struct<bruto: string, motivo: string, etapa: string>>", "tentativas": "int", "erro": "string", "finish_reason": "string", "max_tokens": "int",
}
BATCH_LINE = "id string, resultado struct<" + ", ".join(f"{n}: {t}" for n, t in RESULT.items()) + ">, instante string, " + ", ".join(f"{n} {t}" for n, t in RESULT.items())
