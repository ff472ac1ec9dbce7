"""Document types and groups by ordered rules: the first that matches wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title rules in order, then substrings of the group, then the default.
TITLE_RULES = [
    ("INTERVIEW|TRANSCRIPT|STATEMENT|DEPOSITION|TESTIMONY", "witness_testimony"),
    ("FLIGHT DATA RECORDER|FDR|COCKPIT VOICE RECORDER|CVR|MATERIALS LAB|METALLURGICAL|RADAR DATA|WEATHER STUDY", "technical_analysis"),
    (r"\bFAA\b|AIRWORTHINESS DIRECTIVE|SAFETY RECOMMENDATION|COMPLIANCE|REGULATORY|14 CFR|OVERSIGHT|SMS RULE", "regulatory_filing"),
    (r"QUALITY ALERT|PROCESS INSTRUCTION|INTERNAL|BULLETIN|NCR|NCO|QUALITY ESCAPE|SPEAK UP|SAFETY ACTION|\bQMS\b", "internal_memo"),
    ("PRELIMINARY|OPENING STATEMENT|BOARD MEETING|SEQUENCE OF EVENTS|EXHIBIT LIST", "preliminary_report"),
    ("SUBMISSION|PARTY|PRESENTATION|FOLLOW-UP ANSWER|FINAL SUBMISSION", "expert_deposition"),
    ("FACTUAL REPORT|GROUP CHAIR|GROUP CHAIRMAN|ERRATA|SUPPLEMENT|REPORT", "investigation_report"),
    ("ORDER OF HEARING|DESIGNATION|NOTICE|WITNESS LIST|BIOGRAPHIES", "preliminary_report"),
]
GROUP_HINTS = [
    (["operational", "survival", "structures", "systems"], "investigation_report"),
    (["recorder"], "technical_analysis"),
    (["materials"], "technical_analysis"),
    (["manufacturing", "human performance"], "investigation_report"),
    (["hearing"], "preliminary_report"),
    (["party"], "expert_deposition"),
    (["regulatory"], "regulatory_filing"),
]
DEFAULT_TYPE = "investigation_report"
CANONICAL_TYPES = ["investigation_report", "technical_analysis", "witness_testimony", "regulatory_filing", "press_coverage", "expert_deposition", "internal_memo", "preliminary_report"]
# Group names by the title's number, then by keywords in order.
GROUP_NUMBERS = {"1": "Hearing Documents", "2": "Operational Factors", "6": "Survival Factors", "7": "Structures", "9": "Systems", "10": "Flight Data Recorder", "11": "Manufacturing & Human Performance", "12": "Cockpit Voice Recorder", "15": "Materials"}
GROUP_PREFIX = r"^(\d{1,2})-?[A-Z]?\s"
GROUP_KEYWORDS = [
    ("OPERATIONAL FACTORS", "Operational Factors"),
    ("SURVIVAL FACTORS", "Survival Factors"),
    ("STRUCTURES", "Structures"),
    ("SYSTEMS", "Systems"),
    ("FLIGHT DATA RECORDER", "Flight Data Recorder"),
    ("FDR", "Flight Data Recorder"),
    ("COCKPIT VOICE RECORDER", "Cockpit Voice Recorder"),
    ("CVR", "Cockpit Voice Recorder"),
    ("MANUFACTURING", "Manufacturing & Human Performance"),
    ("HUMAN PERFORMANCE", "Manufacturing & Human Performance"),
    ("MATERIALS", "Materials"),
    ("HEARING", "Hearing Documents"),
    ("BOEING", "Party Submissions"),
    ("SPIRIT", "Party Submissions"),
    ("FAA", "Regulatory"),
    ("BOARD MEETING", "Board Meeting"),
]
# Rules of single sources; a source without rules gives "document".
SOURCE_RULES = {
    "ntsb": (
        [
            ("METEOROLOG|WEATHER STUDY|WEATHER FACTUAL", "meteorology_report"),
            (r"AIR TRAFFIC CONTROL|\bATC\b|CTAF TRANSCRIPT", "atc_transcript"),
            ("OPERATIONAL? FACTORS|OPERATIONS GROUP", "ops_group_report"),
            ("STRUCTURES GROUP|STRUCTURES FACTUAL", "structures_analysis"),
            (r"POWERPLANTS?\b", "powerplants_analysis"),
            ("MAINTENANCE RECORD", "maintenance_record"),
            ("INTERVIEW|STATEMENT|DEPOSITION|TESTIMONY|WITNESS|RECORD OF CONVERSATION", "witness_testimony"),
            ("PRELIMINARY|ORDER OF HEARING|EXHIBIT LIST|BOARD MEETING|STATEMENT OF PURPOSE|WITNESS LIST|DESIGNATION", "preliminary_report"),
        ],
        "investigation_report",
    ),
    "grenfell": ([("transcript|hearing", "hearing_transcript")], "document"),
    "copa": (
        [
            ("fsr|final_summary|final-summary|final summary", "final_summary_report"),
            ("trr|tactical", "tactical_response_report"),
            ("ocir|case-incident|case incident|original-case|original case", "case_incident_report"),
            ("arrest", "arrest_report"),
            ("concur", "superintendent_concurrence"),
        ],
        "document",
    ),
}


def first_match(x: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The value of the first rule whose pattern, whatever the case, is in ``x``."""
    out = default
    for pattern, value in reversed(rules):
        out = F.when(x.rlike(f"(?i){pattern}"), value).otherwise(out)
    return out


def document_type(title: Column, group: Column) -> Column:
    hint = F.lit(DEFAULT_TYPE)
    for words, value in reversed(GROUP_HINTS):
        hint = F.when(F.lower(group).rlike("|".join(words)), value).otherwise(hint)
    return first_match(title, TITLE_RULES, hint)


def document_group(title: Column) -> Column:
    number = F.regexp_extract(title, GROUP_PREFIX, 1)
    names = F.create_map(*[F.lit(x) for kv in GROUP_NUMBERS.items() for x in kv])
    other = F.lit("Other")
    for word, value in reversed(GROUP_KEYWORDS):
        other = F.when(F.contains(F.upper(title), F.lit(word)), value).otherwise(other)
    return F.when(number != "", F.coalesce(names[number], F.concat(F.lit("Group "), number))).otherwise(other)


def source_type(title: Column, source: Column) -> Column:
    out = F.lit("document")
    for name, (rules, default) in SOURCE_RULES.items():
        out = F.when(source == name, first_match(title, rules, F.lit(default))).otherwise(out)
    return out
