"""Polarity of a reason by rules: 1 speaks for a finding, -1 against, 0 is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.text import strip

# fixed values: statements and patterns, in the order in which they are tried
STATEMENTS = ["this eeg is abnormal", "this is an abnormal", "abnormal eeg"]
AGAINST = [
    r"\bno (evidence|indication|suggestion|signs|features|findings)\b",
    r"\bno .* (discharges|transients|changes|abnormalities)\b",
    r"\bno\s+(?:\w+\s+){0,5}?(abnormalities|discharges|features)",
    r"\bno (specific )?mention\b",
    r"\bnot demonstrate\b",
    r"\bno .* (were|was) (noted|observed|seen|identified|detected)\b",
    r"\b(?<!ab)normal\b",
    r"\bthis eeg (can be interpreted as|was|is) (virtually )?normal\b",
    r"\bvirtually normal\b",
    r"\bwithin normal limits\b",
    r"\bbenign\b",
    r"\bno precise (electrophysiological )?diagnosis\b",
    r"\b(emg )?artifact(ual)?\b",
    r"\bmild degree of nonspecific encephalopathy\b",
    r"\bcan be consistent with underlying microstructural\b",
    r"\bconsistent with previous history of infarcts\b",
    r"\bobserved .* could be explained\b",
    r"\bstate of drowsiness alone\b",
    r"\bsuboptimal quality\b",
    r"\bdoes not demonstrate significant epileptiform\b",
    r"\bno significant epileptiform\b",
    r"\binterpreted as normal\b",
    r"\blikely within normal limits\b",
    r"\bbenign electrophysiological phenomenon\b",
    r"\bfeatures suggestive of.*benign\b",
    r"\bno (clear|definitive|associated)? .* (discharges|abnormalities|transients|features)?\b",
    r"\bno (lateralized|generalized|focal)? ?(or )?epileptiform abnormalities\b",
    r"\bno periodic complexes\b",
    r"\bnormal (eeg|record|background|rhythm)\b",
    r"\b(eeg|electroencephalogram|record) (was|is)? (normal|within normal limits)\b",
    r"\bno .* (captured|seen|recorded|were recorded|were found)\b",
    r"^nan$",
    r"^n/?a$",
    r"no explanation given",
]
FOR = [
    r"\babnormal\b",
    r"abnormal.*theta and delta waveforms",
    r"amplitude of (alpha|beta) frequencies",
    r"\basymmetr(y|ical findings)\b",
    r"background slowing",
    r"bitemporal dysrhythmia",
    r"cerebral dysfunction",
    r"consistent with.*(encephalopathy|epilepsy)",
    r"delta (and|&) theta (activity|waveforms)|delta range activity",
    r"diffuse suppression of electrical activity",
    r"disturbance of cerebral function",
    r"\bdysrhythmia\b",
    r"epileptic (features|tendency)",
    r"epileptiform (abnormalities|discharges|disturbance|transients)",
    r"focal seizure",
    r"frontal intermittent rhythmic delta activity",
    r"frontal slowing",
    r"frequent discharges",
    r"generalized disturbance( of cerebral function)?",
    r"generalized (epileptiform )?disturbance",
    r"generalized (delta|theta) activity",
    r"impairment of cerebral function",
    r"increased (amplitude|frequencies)",
    r"ischemic stroke",
    r"(left|right) hemisphere slowing",
    r"localized abnormality",
    r"microstructural change",
    r"(mild|moderate|severe) abnormality",
    r"moderate-to-severe degree of.*disturbance",
    r"parietal central regions",
    r"phase reversal",
    r"right posterior rhythmic activity",
    r"sharp (contoured features|transients|wave)",
    r"sharply contoured transients",
    r"slow wave (activity|discharges)",
    r"spike( and)? wave activity|spike discharges",
    r"suppression of background",
    r"temporal (dysrhythmia|slowing)",
    r"theta range activity",
    r"triphasic transients",
    r"wicket waves",
]


def any_of(patterns: list[str]) -> str:
    """One alternation, so a rule set is one match instead of one for each pattern."""
    return "|".join(f"(?:{p})" for p in patterns)


def reason_polarity(reason: Column) -> Column:
    """Empty or null gives 0; then a plain statement, the patterns against, the patterns for; what is left is -1.

    Word classes are Unicode's and a dot stops at line feeds only.
    """
    s = strip(F.lower(F.coalesce(reason, F.lit(""))))
    stated = F.contains(s, F.lit(STATEMENTS[0]))
    for x in STATEMENTS[1:]:
        stated = stated | F.contains(s, F.lit(x))
    return F.when(s == "", 0).when(stated, 1).when(F.rlike(s, F.lit("(?Ud)" + any_of(AGAINST))), -1).when(F.rlike(s, F.lit("(?Ud)" + any_of(FOR))), 1).otherwise(-1)
