"""Ordered rules over normalised question labels: key, whether the rule is broad, and the countries a label names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# (key, pattern, broad): the first match wins; what a broad rule claims is reviewed.
RULES = [
    ("preferred_name", "\\b(preferred|nick)( first)? ?name\\b", False),
    ("first_name", "\\b(first|given) name\\b", False),
    ("last_name", "\\b(last|family|sur) ?name\\b", False),
    ("full_name", "^(your |full |legal )?(full )?name$|^legal name$", False),
    ("email", "\\be ?mail\\b", False),
    ("phone", "\\b(phone|mobile|contact number|whatsapp)\\b|^\\d{1,3}$", False),
    ("resume", "\\b(resume|cv)\\b", False),
    ("cover_letter", "\\bcover letter\\b", False),
    ("linkedin_url", "\\blinkedin\\b", False),
    ("github_url", "\\bgithub\\b", False),
    ("twitter_url", "\\btwitter\\b", False),
    ("portfolio_url", "\\bportfolio\\b|\\bwebsite\\b|\\bblog\\b|personal (site|url)", False),
    ("visa_sponsorship", "\\bsponsor", False),
    ("work_authorization", "authori[sz]ed to work|work authori[sz]ation|right to work|eligible to work|legally (able|permitted)", False),
    ("relocation", "\\brelocat", False),
    ("notice_period", "\\bnotice period\\b", False),
    ("start_date", "start date|when can you (start|join)|earliest (date|start)|available to (start|join)|joining date|availability", False),
    ("salary_expectation", "\\b(salary|compensation|ctc|stipend|pay) (expectation|requirement|expected)|expected (ctc|salary|stipend|compensation)|desired (salary|pay)|current ctc", False),
    ("how_heard", "how did you (hear|find|learn|come)|where did you (hear|find|see)|\\bsource\\b", True),
    ("referral", "\\brefer(red|ral|rer)\\b", False),
    ("previously_employed", "(previously|ever|have you) (worked|been employed)|former employee|worked (here|for us|at)", False),
    ("graduation_date", "graduat(ion|e|ing) (date|year|month)|year of (graduation|passing)|passing (out )?year|expected graduation", False),
    ("gpa", "\\b(c?gpa|grade point|percentage|cpi)\\b", False),
    ("major", "\\b(major|field of study|discipline|speciali[sz]ation|branch|stream)\\b", False),
    ("degree", "\\bdegree\\b|highest (level of )?education|education level|qualification", True),
    ("university", "\\b(university|college|institute|institution|school)\\b", True),
    ("years_experience", "years? of (relevant |professional |work )?experience|how many years", False),
    ("current_company", "current (company|employer|organi[sz]ation)", False),
    ("current_title", "current (title|role|designation|position)", False),
    ("location_current", "current(ly)? (location|city|based)|where are you (currently )?(located|based)|^location$|^city$|city of residence|place of residence", True),
    ("work_mode_ok", "(willing|able|comfortable) to work (on ?site|in (the )?office|from (the )?office|remotely|hybrid)|in[- ]office|on[- ]?site", False),
    ("pronouns", "\\bpronoun", False),
    ("gender", "\\bgender\\b|\\bsex\\b", False),
    ("race_ethnicity", "\\b(race|ethnic|hispanic|latin[oax])", False),
    ("veteran_status", "veteran", False),
    ("disability_status", "disabilit|differently abled|\\bpwd\\b|handicap", False),
    ("age_18_plus", "\\b18\\b|over the age|legal age", False),
    ("languages", "languages? (do you )?(speak|know)|language proficiency|fluent in|proficien(t|cy) in english", False),
    ("timezone", "time ?zone", False),
    ("ai_policy_ack", "\\bai\\b.*(policy|use|usage)|artificial intelligence", False),
    ("privacy_consent", "privacy|consent|gdpr|data (processing|protection|retention)|i (agree|acknowledge|certify)", True),
    ("why_company", "why (do you want|are you interested|us\\b|this (role|company)|join|should we)|what (interests|excites|attracts) you", False),
    ("additional_info", "additional information|anything else|message to (the )?hiring|note to", False),
]
COUNTRY_KEYS = ("work_authorization", "visa_sponsorship")
COUNTRIES = {"united states": "us", "u s": "us", "us": "us", "usa": "us", "america": "us", "uk": "uk", "united kingdom": "uk", "india": "india", "canada": "canada", "germany": "germany", "european union": "eu", "eu": "eu", "australia": "australia", "singapore": "singapore", "ireland": "ireland", "netherlands": "netherlands", "france": "france", "japan": "japan"}
#: Fields that are named, not asked about: a long label that mentions one is another question.
FIELD_KEYS = ("preferred_name", "first_name", "last_name", "full_name", "email", "phone", "resume", "cover_letter", "linkedin_url", "github_url", "twitter_url", "portfolio_url", "location_current", "current_company", "current_title", "university", "degree", "major", "pronouns", "gender")
FIELD_MAX_WORDS, QUESTION_MAX_WORDS = 8, 40
FAMILIES = {"select": "choice", "multi_select": "choice", "boolean": "choice", "text": "free text", "textarea": "free text", "url": "free text", "email": "free text", "phone": "free text", "number": "free text", "location": "free text"}


def countries_in(label: Column) -> Column:
    """Codes of the countries a normalised label names, each once, sorted."""
    table = F.create_map(*[F.lit(x) for kv in COUNTRIES.items() for x in kv])
    names = "|".join(sorted(COUNTRIES, key=lambda c: (-len(c), c)))
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(label, F.lit(f"\\b({names})\\b"), F.lit(1)), lambda m: F.element_at(table, m))))


def rule_key(label: Column) -> Column:
    """struct(key, broad) of the first rule that claims a normalised label; null if none."""
    words, c = F.size(F.regexp_extract_all(label, F.lit("(\\S+)"), F.lit(1))), None
    named = countries_in(label)
    for key, pattern, broad in RULES:
        hit = label.rlike(pattern)
        if key in FIELD_KEYS:
            hit &= words <= FIELD_MAX_WORDS
        name = F.when(F.size(named) == 1, F.concat(F.lit(f"{key}."), named[0])).otherwise(key) if key in COUNTRY_KEYS else F.lit(key)
        value = F.struct(name.alias("key"), F.lit(broad).alias("broad"))
        c = F.when(hit, value) if c is None else c.when(hit, value)
    return F.when(words <= QUESTION_MAX_WORDS, c)


def family(kind: Column) -> Column:
    """Kind of answer of a field type: choice, free text or the type itself."""
    table = F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, kind), kind, F.lit("none"))
