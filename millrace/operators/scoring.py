"""The keyword score: share of the profile's skills that a posting mentions, less a capped penalty for ruled-out ones."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.places import location_match, work_mode_match
from millrace.functions.text import Fold, bind, fold, let, normalize, occurs
from millrace.operators.synonyms import Synonyms

ABSENT_PENALTY, ABSENT_PENALTY_CAP = 0.34, 1.0


class ScorerConfigError(ValueError):
    """What only a change of configuration mends; raised when a scorer is made."""


@dataclass(frozen=True)
class Profile:
    role: str = ""
    skills: Sequence[str] = ()
    absent_skills: Sequence[str] = ()
    locations: Sequence[str] = ()
    work_mode: str = "unknown"
    experience_years: int | None = None


@dataclass(frozen=True)
class ScoreRule:
    synonyms: Sequence[Sequence[str]] = ()
    absent_skill_penalty: float = ABSENT_PENALTY
    absent_skill_penalty_cap: float = ABSENT_PENALTY_CAP
    fold: Fold = field(default=fold)

    def __post_init__(self) -> None:
        if self.absent_skill_penalty < 0:
            raise ValueError("absent_skill_penalty must be 0 or more")
        if not 0 <= self.absent_skill_penalty_cap <= 1:
            raise ValueError("absent_skill_penalty_cap must be between 0 and 1")


def content() -> Column:
    """The plain text, or the raw one where that is null or empty."""
    return F.when(F.length("description_clean") > 0, F.col("description_clean")).otherwise(F.col("description_raw"))


def mentioned_text() -> Column:
    """Where skills are looked for."""
    return F.concat(F.col("title"), F.lit("\n"), F.coalesce(content(), F.lit("")))


_WORD = re.compile(r"[0-9a-z]+")


def _seen(text: Column, skills: Sequence[str], synonyms: Synonyms, fold: Fold) -> Column:
    """Those of all forms of ``skills`` that ``text`` has. A form that is one word is there if it is one of the text's words,
    all of which are looked up at once; other forms are looked for in the normalised text, which is made only for them."""
    forms = sorted({f for s in skills for f in synonyms.forms(s)})
    words, others = [f for f in forms if _WORD.fullmatch(f)], [f for f in forms if not _WORD.fullmatch(f)]
    none = F.array().cast("array<string>")

    def of(folded: Column) -> Column:
        own = F.array_intersect(F.regexp_extract_all(folded, F.lit("[0-9a-z]+"), F.lit(0)), F.array(*map(F.lit, words))) if words else none
        if not others:
            return own
        hits = lambda hay: F.array(*[F.when(F.contains(hay, F.lit(f)) & occurs(hay, [f]), F.lit(f)) for f in others])
        return F.concat(own, F.array_compact(let(normalize(folded, lambda t: t), hits)))

    return let(fold(text), of) if forms else none


def _mentioned(seen: Column, skills: Sequence[str], synonyms: Synonyms) -> Column:
    """An array of (skill, whether one of its forms is in ``seen``), in the order given."""
    if not skills:
        return F.array().cast("array<struct<skill:string,hit:boolean>>")
    hit = lambda forms: F.arrays_overlap(seen, F.array(*map(F.lit, sorted(forms)))) if forms else F.lit(False)
    return F.array(*[F.struct(F.lit(s).alias("skill"), hit(synonyms.forms(s)).alias("hit")) for s in skills])


def _names(mentions: Column, hit: bool) -> Column:
    return F.transform(F.filter(mentions, lambda x: x["hit"] == hit), lambda x: x["skill"])


def _plural(count: Column) -> Column:
    return F.when(count == 1, "skill").otherwise("skills")


def half_up(share: Column) -> Column:
    """A share in points, halves upwards, in double arithmetic."""
    return F.floor(share * F.lit(100.0) + F.lit(0.5)).cast("int")


def keyword_score(postings: DataFrame, profile: Profile, rule: ScoreRule | None = None) -> DataFrame:
    """``postings`` (title, description_clean, description_raw, location, eligible_locations, work_mode) with the eight
    columns of a score, replaced where there are some. One projection; the text is folded once per row."""
    rule = rule or ScoreRule()
    synonyms, own = Synonyms(rule.synonyms), len(profile.skills)

    def seen(forms: Column) -> Column:
        return let(
            F.struct(_mentioned(forms, profile.skills, synonyms).alias("have"), _mentioned(forms, profile.absent_skills, synonyms).alias("ruled")),
            lambda m: let(F.struct(_names(m["have"], True).alias("matched"), _names(m["have"], False).alias("unmatched"), _names(m["ruled"], True).alias("penalized")), scored),
        )

    def scored(names: Column) -> Column:
        coverage = F.size(names["matched"]) / F.lit(float(max(own, 1)))
        penalty = F.least(F.lit(float(rule.absent_skill_penalty)) * F.size(names["penalized"]), F.lit(float(rule.absent_skill_penalty_cap)))
        score = half_up(F.least(F.lit(1.0), F.greatest(F.lit(0.0), coverage - penalty))) if own else F.lit(0)
        return F.struct(names["matched"].alias("matched"), names["unmatched"].alias("unmatched"), names["penalized"].alias("penalized"), score.alias("score"), half_up(coverage).alias("points"))

    # One bound expression, as a filter on the score would otherwise repeat the folding for each skill.
    named = bind(postings, __seen=let(_seen(mentioned_text(), [*profile.skills, *profile.absent_skills], synonyms, rule.fold), seen)).withColumns(
        {
            "matched_skills": F.col("__seen.matched"),
            "unmatched_profile_skills": F.col("__seen.unmatched"),
            "penalized_skills": F.col("__seen.penalized"),
            "score": F.col("__seen.score"),
            "missing_requirements": F.array().cast("array<string>"),
            "location_match": location_match(F.col("location"), F.col("eligible_locations"), profile.locations, rule.fold),
            "work_mode_match": work_mode_match(F.col("work_mode"), profile.work_mode),
        }
    )
    matched, unmatched, penalized = F.size("matched_skills"), F.col("unmatched_profile_skills"), F.size("penalized_skills")
    if own:
        head = F.concat(F.lit("matched "), matched.cast("string"), F.lit(f"/{own} {'skill' if own == 1 else 'skills'}"))
        head = F.concat(head, F.when(matched > 0, F.concat(F.lit(" ("), F.array_join("matched_skills", ", "), F.lit(")"))).otherwise(""))
        summary = F.concat_ws(
            "; ",
            head,
            F.when(F.size(unmatched) > 0, F.concat(F.lit("not mentioned: "), F.array_join(unmatched, ", "))),
            F.when(
                penalized > 0,
                F.concat(F.lit("penalty -"), (F.col("__seen.points") - F.col("score")).cast("string"), F.lit(": posting mentions ruled-out "), _plural(penalized), F.lit(" "), F.array_join("penalized_skills", ", ")),
            ),
            F.when(F.col("location_match"), "location fits").when(~F.col("location_match"), "location does not fit"),
            F.when(F.col("work_mode_match"), "work mode fits").when(~F.col("work_mode_match"), "work mode differs"),
        )
    else:
        summary = F.lit("profile lists no skills; the keyword scorer cannot rank this posting")
    return named.withColumn("summary", summary).drop("__seen")


# -- scorers -----------------------------------------------------------------------------------------------------------


class Scorer(ABC):
    """Scores postings against a profile."""

    @abstractmethod
    def score(self, postings: DataFrame, profile: Profile) -> DataFrame:
        """``postings`` (url and what is scored) with the columns of a score, and ``failure``: null where a posting is scored,
        else why it is not. A scorer with a budget leaves out the postings that it did not come to. Raises
        ScorerConfigError only."""

    #: Whether the last call left postings out, as its budget was used up.
    stopped_early = False


_SCORERS: dict[str, Callable[[Mapping[str, Any]], Scorer]] = {}


def register_scorer(*names: str) -> Callable:
    """``make``: from the options of a configuration's scoring block to a scorer."""

    def add(make: Callable[[Mapping[str, Any]], Scorer]) -> Callable[[Mapping[str, Any]], Scorer]:
        for name in names:
            if name in _SCORERS:
                raise ValueError(f"there already is a scorer {name!r}")
            _SCORERS[name] = make
        return make

    return add


def scorer_names() -> list[str]:
    return sorted(_SCORERS)


def make_scorer(block: Mapping[str, Any]) -> Scorer:
    name = block.get("backend", "keyword")
    if name not in _SCORERS:
        raise ScorerConfigError(f"unknown scoring backend {name!r}; known: {', '.join(scorer_names())}")
    return _SCORERS[name]({k: v for k, v in block.items() if k != "backend"})


@register_scorer("keyword", "keyword_match")
class KeywordScorer(Scorer):
    """Native columns only: never fails, and has no budget."""

    def __init__(self, options: Mapping[str, Any] | None = None):
        options = dict(options or {})
        if unknown := sorted(set(options) - {"synonyms", "absent_skill_penalty", "absent_skill_penalty_cap"}):
            raise ScorerConfigError(f"scoring: unknown key {', '.join(unknown)}")
        try:
            self.rule = ScoreRule(**options)
        except ValueError as e:
            raise ScorerConfigError(f"scoring: {e}") from e

    def score(self, postings: DataFrame, profile: Profile) -> DataFrame:
        return keyword_score(postings, profile, self.rule).withColumn("failure", F.lit(None).cast("string"))
