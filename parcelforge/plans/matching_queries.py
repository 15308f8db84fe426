"""Queries that match records to properties, with the same rows in SQL by comparing all pairs."""

from __future__ import annotations

from parcelforge.functions.text import DIRECTIONS, STREET_WORDS
from parcelforge.operators import matching
from parcelforge.plans.adapters import view
from parcelforge.plans.catalog import hav, query, rounded


def _words(text: str, words: dict[str, str]) -> str:
    case = " ".join(f"when '{a}' then '{b}'" for a, b in words.items())
    return f"array_to_string(list_transform(string_split({text}, ' '), lambda w: case w {case} else w end), ' ')"


def _token(text: str) -> str:
    return f"nullif(trim(regexp_replace(upper({text}), '[^A-Z0-9]+', ' ', 'g')), '')"


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, one row of the table after another."""
    code = lambda t: f"list_transform(string_split({t}, ''), lambda c: cast(ord(c) as bigint))"
    inner = f"list_reduce(list_prepend(cast([0] as bigint[]), list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j: list_append(acc, greatest(acc[-1], row_[j[1] + 1], row_[j[1]] + case when {code(b)}[j[1]] = e[1] then 1 else 0 end)))"
    rows = f"list_prepend(list_transform(range(0, length({b}) + 1), lambda j: cast(0 as bigint)), list_transform({code(a)}, lambda c: [c]))"
    return f"list_reduce({rows}, lambda row_, e: {inner})[-1]"


def _alike(a: str, b: str) -> str:
    """0 where the lengths alone rule out 0.75."""
    both = f"(length({a}) + length({b}))"
    sort = lambda t: f"array_to_string(list_sort(string_split({t}, ' ')), ' ')"
    return f"case when {a} is null or {b} is null or 2.0 * least(length({a}), length({b})) < 0.75 * {both} then 0.0::double when {a} = {b} then 1.0::double else 2.0::double * greatest({_lcs(a, b)}, {_lcs(sort(a), sort(b))}) / {both} end"


def _addresses(table: str, key: str) -> str:
    unit = _token("suite")
    strict = f"regexp_replace({_words(_token('street'), DIRECTIONS)}, '\\b([NS]) ([EW])\\b', '\\1\\2', 'g')"
    return f"""(select *, {_words('strict', STREET_WORDS)} as plain, nullif(concat_ws(' ', number, strict, unit_), '') as strict_full, nullif(concat_ws(' ', number, {_words('strict', STREET_WORDS)}, unit_), '') as full_,
  nullif(concat_ws(' ', number, strict), '') as strict_base, nullif(concat_ws(' ', number, {_words('strict', STREET_WORDS)}), '') as base from (
  select {key} as id, regexp_replace({unit}, '^UNIT ', '') as unit_, {_token('house')} as number, {strict} as strict, {_words(_token('legal_description'), matching.LEGAL_WORDS)} as legal, year_built, gross_area, lat, lon from {table}))"""


_MATCHED = f"""
p as materialized (select *, count(*) over (partition by base) as units from {_addresses("homes", "location_id")}),
s as materialized (select * from {_addresses("offers", "source_record_id")}),
near as materialized (select p.id as pid, s.id as sid, p.units, p.unit_ as p_unit, s.unit_ as s_unit, p.number = s.number as house, p.full_ = s.full_ as full_same, p.strict_full <> s.strict_full as strict_apart, p.legal = s.legal as legal_same, p.base = s.base as base_same,
  p.strict_base <> s.strict_base as strict_base_apart, p.year_built = s.year_built as year_same, 1 - abs(p.gross_area - s.gross_area) / greatest(p.gross_area, s.gross_area) as area, {hav("p.lat", "p.lon", "s.lat", "s.lon")} as metres, s.lat is not null as placed,
  {_alike("p.plain", "s.plain")} as street_like, p.base as p_base, s.base as s_base from p join s on p.number = s.number or p.full_ = s.full_ or p.legal = s.legal),
met as materialized (select *, case when street_like >= 0.75 or legal_same then {_alike("p_base", "s_base")} else 0 end as base_like from near),
scored as (select pid, sid, case when risk then 'suite_missing_multi_unit' when full_same and not strict_apart then 'exact_address_suite' when full_same then 'fuzzy_address_geo' when legal_same then 'exact_legal_description' else 'fuzzy_address_geo' end as match_method,
  case when risk then 0.96::double when full_same and strict_apart then 0.965::double when full_same then 0.99::double when legal_same then 0.97::double
  else least(0.96::double, 0.70::double + 0.15::double * base_like + case when year_same then 0.15::double else 0 end + coalesce(0.20::double * area, 0) + case when placed and metres <= 15 then 0.20::double when placed and metres <= 40 then 0.10::double else 0 end) end as confidence,
  case when risk then 'suite_missing_multi_unit' when full_same then case when strict_apart then 'typo_normalized_match' end when legal_same then null when base_same and strict_base_apart then 'typo_normalized_match' end as reason_code
  from (select *, coalesce(units > 1 and p_unit is not null and s_unit is null and house and base_like >= 0.95, false) as risk from met) where risk or full_same or legal_same or (house and street_like >= 0.86)),
best as (select pid as location_id, sid as source_record_id, match_method, confidence, close or match_method = 'suite_missing_multi_unit' as held, case when close then 'ambiguous_match_candidates' else reason_code end as reason_code from (
  select *, coalesce(confidence - nxt < 0.03, false) as close from (select *, lead(confidence) over w as nxt, row_number() over w as r from scored window w as (partition by pid order by confidence desc, sid)) where r = 1))
"""


@query(", " + _MATCHED + "select location_id, source_record_id, match_method, round(confidence, 4) as confidence, held as ambiguous, held as quarantined, reason_code from best", ("homes", "offers"))
def address_cascade(spark, sf):
    return rounded(matching.match(view(spark, sf, "homes"), view(spark, sf, "offers")))


@query(", " + _MATCHED + """select location_id, source_record_id, case when tied and any_risk then 'suite_missing_multi_unit' else match_method end as match_method, round(confidence, 4) as confidence, tied or risky or held as quarantined,
  case when tied then case when any_risk then 'suite_missing_multi_unit' else 'duplicate_source_record_match' end else reason_code end as reason_code from (
  select *, not risky and coalesce(abs(confidence - nxt) < 1e-9, false) as tied from (
  select *, row_number() over w as r, lead(confidence) over w as nxt, bool_or(match_method = 'suite_missing_multi_unit') over (partition by source_record_id) as any_risk from (select *, coalesce(reason_code = 'suite_missing_multi_unit', false) as risky from best)
  window w as (partition by source_record_id order by risky desc, confidence desc, match_method = 'exact_address_suite' desc, match_method = 'exact_legal_description' desc, location_id))) where r = 1""", ("homes", "offers"))
def source_assignments(spark, sf):
    found = matching.one_property_each(matching.match(view(spark, sf, "homes"), view(spark, sf, "offers")))
    return rounded(found.drop("ambiguous"))


@query(", " + _MATCHED + f"""select s.id as source_record_id, case when s.base is null then 'missing_address_components' when s.unit_ is null and u.n > 1 then 'suite_missing_multi_unit' when h.number is null then 'no_house_number_match'
  when l.likeness >= 0.75 then 'fuzzy_below_threshold' else 'street_name_mismatch' end as reason_code, coalesce(s.strict_base, s.base, 'UNKNOWN') as pattern
from s left join (select base, count(*) as n from p group by 1) u on u.base = s.base left join (select distinct number from p) h on h.number = s.number
left join (select sid as id, max(street_like) as likeness from near where house group by 1) l on l.id = s.id where s.id not in (select source_record_id from best)""", ("homes", "offers"))
def unmatched_sources(spark, sf):
    p, s = view(spark, sf, "homes"), view(spark, sf, "offers")
    return matching.unmatched_reasons(p, s, matching.match(p, s))
