"""The label contract: 45 tags in frozen order, their stage, threshold budget, action and severity."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession

# Tags by stage, in contract order, with their threshold budget; * marks specially protected ones.
STAGE_1 = "AHVN13 UID IBAN QR_REFERENCE CREDITCARD GLN"
STAGE_2 = "EGID/R EWID/R MUNICIPALITY_ID/R INSURANCE_CARD*/R PHONE/A PLATE/A ZIPCODE/P AMOUNT/P PERMIT_TYPE/R IDDOC/R ZSR_RCC/R PATIENT_ID*/R CASE_ID/A PARCEL/A URL/P IPADDRESS/P EMAIL/R"
STAGE_3 = "FULLNAME/R GIVENNAME/R DATE/R TIME/R STREET/R BUILDINGNUM/R CITY/A COUNTRY/P AGE/A SEX/A MARITALSTATUS/A RELIGION*/R NATIONALITY*/R SOCIAL_INSURANCE*/R INSURANCE_POLICY*/R RESIDENCE_STATUS/A VOTING_RIGHTS/A PLACE_OF_ORIGIN/R CANTON/P ORG/R HEALTHCARE_ORG*/R USERNAME/R"
BUDGETS = {"R": 0.30, "A": 0.50, "P": 0.70}
EXCEPTIONS = {"ORG": 0.40}
TAG_ONLY = frozenset({"CANTON"})
# Severity of a leak by kind of detail.
DIRECT = frozenset("AHVN13 UID IBAN QR_REFERENCE CREDITCARD GLN INSURANCE_CARD IDDOC ZSR_RCC PATIENT_ID EMAIL PHONE PLATE FULLNAME EGID EWID STREET CASE_ID SOCIAL_INSURANCE INSURANCE_POLICY".split())
QUASI = frozenset("GIVENNAME DATE BUILDINGNUM ZIPCODE CITY AGE SEX MARITALSTATUS RELIGION NATIONALITY PARCEL AMOUNT PERMIT_TYPE RESIDENCE_STATUS MUNICIPALITY_ID HEALTHCARE_ORG IPADDRESS".split())
WEIGHTS = {"direct": 3.0, "quasi": 1.0, "context": 0.2, "protected_factor": 1.5}
PROPAGATED = ("FULLNAME", "GIVENNAME", "ORG", "HEALTHCARE_ORG", "STREET")
IN_PARTS = ("FULLNAME", "ORG", "HEALTHCARE_ORG")


class Tag(tuple):
    """(name, stage, budget, protected, action)"""

    name = property(lambda s: s[0])
    stage = property(lambda s: s[1])
    budget = property(lambda s: s[2])
    protected = property(lambda s: s[3])
    action = property(lambda s: s[4])


def _tags() -> tuple[Tag, ...]:
    out = []
    for stage, line in ((1, STAGE_1), (2, STAGE_2), (3, STAGE_3)):
        for item in line.split():
            name, _, budget = item.partition("/")
            plain = name.rstrip("*")
            out.append(Tag((plain, stage, budget or None, name.endswith("*"), "tag_only" if plain in TAG_ONLY else "mask")))
    return tuple(out)


TAGS = _tags()
STAGES = {t.name: t.stage for t in TAGS}
ACTIONS = {t.name: t.action for t in TAGS}
#: Threshold of each tag; tags of stage 1 have none, their check digits decide.
THRESHOLDS = {t.name: EXCEPTIONS.get(t.name, BUDGETS[t.budget]) for t in TAGS if t.budget}


def severity(tag: str) -> float:
    base = WEIGHTS["direct"] if tag in DIRECT else WEIGHTS["quasi"] if tag in QUASI else WEIGHTS["context"]
    return base * (WEIGHTS["protected_factor"] if any(t.name == tag and t.protected for t in TAGS) else 1.0)


def bio_labels() -> tuple[str, ...]:
    """O, then B- and I- of each tag in contract order."""
    return ("O", *(f"{p}-{t.name}" for t in TAGS for p in "BI"))


def label_hash() -> str:
    return sha256("\n".join(bio_labels()).encode()).hexdigest()


def tag_table(spark: SparkSession) -> DataFrame:
    rows = [(i, t.name, t.stage, t.budget, t.protected, t.action, THRESHOLDS.get(t.name), severity(t.name)) for i, t in enumerate(TAGS, 1)]
    return spark.createDataFrame(rows, "index int, tag string, stage int, budget string, protected boolean, action string, threshold double, severity double")


def check(tags: tuple[Tag, ...] = TAGS) -> list[str]:
    """Findings against the contract's own rules; empty if it holds."""
    names = [t.name for t in tags]
    out = [f"duplicate tag {n}" for n in sorted(set(names)) if names.count(n) > 1]
    out += [f"{t.name}: stage {t.stage}" for t in tags if t.stage not in (1, 2, 3)]
    out += [f"{t.name}: action {t.action}" for t in tags if t.action not in ("mask", "tag_only")]
    out += [f"{t.name}: stage 1 has no budget" for t in tags if t.stage == 1 and t.budget]
    out += [f"{t.name}: needs a budget" for t in tags if t.stage > 1 and t.budget not in BUDGETS]
    return out


def excluded_tags(wanted: set[str], consent: bool = False) -> set[str]:
    """Tags to be left readable: unknown ones are rejected, specially protected ones need explicit consent."""
    unknown = wanted - set(STAGES)
    if unknown:
        raise ValueError(f"unknown tags: {sorted(unknown)}")
    guarded = {t.name for t in TAGS if t.protected} & wanted
    if guarded and not consent:
        raise ValueError(f"specially protected, consent needed: {sorted(guarded)}")
    return wanted
