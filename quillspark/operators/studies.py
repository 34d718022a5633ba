"""Registry studies: deep records flattened to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MEASURE = "struct<title:string,unitOfMeasure:string,classes:array<struct<title:string,categories:array<struct<title:string,measurements:array<struct<groupId:string,value:string,spread:string>>>>>>>"
_EVENT = "struct<organSystem:string,term:string,stats:array<struct<groupId:string,numAffected:long,numAtRisk:long,numEvents:long>>>"
_GROUPS = "array<struct<id:string,title:string>>"
#: Every key is optional; absent ones are null.
STUDY = (
    "struct<protocolSection:struct<identificationModule:struct<nctId:string,briefTitle:string,officialTitle:string>,statusModule:struct<overallStatus:string>,"
    "designModule:struct<studyType:string,phases:array<string>,enrollmentInfo:struct<count:long,type:string>>,sponsorCollaboratorsModule:struct<leadSponsor:struct<name:string>>,conditionsModule:struct<conditions:array<string>>>,"
    f"resultsSection:struct<baselineCharacteristicsModule:struct<groups:{_GROUPS},measures:array<{_MEASURE}>>,adverseEventsModule:struct<eventGroups:{_GROUPS},seriousEvents:array<{_EVENT}>,otherEvents:array<{_EVENT}>>>>"
)


def _joined(values: Column) -> Column:
    return F.array_join(F.coalesce(values, F.array().cast("array<string>")), "; ")


def summary(studies: DataFrame, s: str = "study") -> DataFrame:
    """One flat row a study, beside the input's columns."""
    p = F.col(s)["protocolSection"]
    ident, design = p["identificationModule"], p["designModule"]
    return studies.select(
        *[c for c in studies.columns if c != s],
        ident["nctId"].alias("nct_id"), ident["briefTitle"].alias("brief_title"), ident["officialTitle"].alias("official_title"),
        p["statusModule"]["overallStatus"].alias("status"), design["studyType"].alias("study_type"), _joined(design["phases"]).alias("phases"),
        design["enrollmentInfo"]["count"].alias("enrollment_count"), design["enrollmentInfo"]["type"].alias("enrollment_type"),
        p["sponsorCollaboratorsModule"]["leadSponsor"]["name"].alias("lead_sponsor"), _joined(p["conditionsModule"]["conditions"]).alias("conditions"),
    )


def _titles(groups: Column) -> Column:
    return F.map_from_entries(F.transform(F.coalesce(groups, F.array().cast(_GROUPS)), lambda g: F.struct(g["id"], g["title"])))


def baseline(studies: DataFrame, s: str = "study") -> DataFrame:
    """One row for each measurement; a group without a title goes by its id."""
    nct, module = F.col(s)["protocolSection"]["identificationModule"]["nctId"], F.col(s)["resultsSection"]["baselineCharacteristicsModule"]
    measures = studies.select(nct.alias("nct_id"), _titles(module["groups"]).alias("titles"), F.explode(module["measures"]).alias("m"))
    classes = measures.select("nct_id", "titles", F.col("m.title").alias("measure"), F.col("m.unitOfMeasure").alias("unit"), F.explode("m.classes").alias("c"))
    categories = classes.select("nct_id", "titles", "measure", "unit", F.col("c.title").alias("class"), F.explode("c.categories").alias("g"))
    cells = categories.select("nct_id", "titles", "measure", "unit", "class", F.col("g.title").alias("category"), F.explode("g.measurements").alias("x"))
    named = F.when(F.map_contains_key("titles", F.col("x.groupId")), F.try_element_at("titles", F.col("x.groupId"))).otherwise(F.col("x.groupId"))
    return cells.select("nct_id", "measure", "unit", "class", "category", F.col("x.groupId").alias("group_id"), named.alias("group"), F.col("x.value").alias("value"), F.col("x.spread").alias("spread"))


def adverse_events(studies: DataFrame, s: str = "study") -> DataFrame:
    """Serious and other events in one table, tagged."""
    nct, module = F.col(s)["protocolSection"]["identificationModule"]["nctId"], F.col(s)["resultsSection"]["adverseEventsModule"]
    both = F.array(F.struct(F.lit("serious").alias("severity"), module["seriousEvents"].alias("events")), F.struct(F.lit("other").alias("severity"), module["otherEvents"].alias("events")))
    kinds = studies.select(nct.alias("nct_id"), _titles(module["eventGroups"]).alias("titles"), F.inline(both))
    events = kinds.select("nct_id", "titles", "severity", F.explode("events").alias("e"))
    stats = events.select("nct_id", "titles", "severity", F.col("e.organSystem").alias("organ_system"), F.col("e.term").alias("term"), F.explode("e.stats").alias("x"))
    named = F.when(F.map_contains_key("titles", F.col("x.groupId")), F.try_element_at("titles", F.col("x.groupId"))).otherwise(F.col("x.groupId"))
    return stats.select("nct_id", "severity", "organ_system", "term", named.alias("group"), F.col("x.numAffected").alias("affected"), F.col("x.numAtRisk").alias("at_risk"), F.col("x.numEvents").alias("events"))
