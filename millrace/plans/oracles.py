"""The registered queries as plain SQL over the same tables, for checking."""

from __future__ import annotations

from millrace.functions import text, verbs
from millrace.operators.models import SEED
from millrace.operators.summary import WORD
from millrace.plans import abt
from millrace.plans.queries import CITY_EFFECTS, EFFECTS, NOISE_LEVEL, REGISTERED, YEAR_A, YEAR_B
from millrace.sources.fixtures import DESCRIPTIONS

# Columns of the given tables, as Spark names their types.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _str(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_str(v) for v in values) + "]"


_DESCRIPTION = "\n".join(f"    when {i} then {_str(d)}" for i, d in enumerate(DESCRIPTIONS))

CLAIMS = f"""claims as (
 select 'WC' || lpad(cast(o_orderkey as varchar), greatest(7, cast(length(cast(o_orderkey as varchar)) as int)), '0') as ClaimNumber,
  make_timestamp(year(o_orderdate), month(o_orderdate), day(o_orderdate), o_orderkey % 24, 0, 0) as DateTimeOfAccident,
  cast(o_orderdate as date) + cast(o_custkey % 500 as int) as DateReported,
  cast(18 + o_custkey % 48 as int) as Age,
  case o_custkey % 7 when 0 then 'U' when 1 then 'F' when 2 then 'F' when 3 then 'F' else 'M' end as Gender,
  case o_custkey % 11 when 0 then cast(null as varchar) when 1 then 'U' when 2 then 'S' when 3 then 'S' else 'M' end as MaritalStatus,
  cast(o_custkey % 4 as int) as DependentChildren, cast(o_custkey % 3 as int) as DependentsOther,
  cast(200 + o_custkey % 1800 as double) as WeeklyWages,
  case when o_custkey % 5 = 0 then 'P' else 'F' end as PartTimeFullTime,
  cast(o_orderkey % 121 as double) as HoursWorkedPerWeek, cast(o_custkey % 8 as int) as DaysWorkedPerWeek,
  case o_orderkey % {len(DESCRIPTIONS)}
{_DESCRIPTION}
  end as ClaimDescription,
  case when o_orderkey % 37 = 0 then cast(1 as double) else o_totalprice / 50 end as InitialIncurredCalimsCost,
  case when o_orderkey % 97 = 0 then o_totalprice * 20 else o_totalprice / 10 end as UltimateIncurredClaimCost,
  case when o_orderkey % 5 = 0 then 'test' else 'train' end as split
 from orders)"""

EMISSIONS = """emissions as (
 select l_orderkey, l_linenumber, n_name as country_id, p_brand as nace_desc, p_type as activity_desc, s_name as city,
  cast(year(l_shipdate) as int) as year_comp,
  case when l_linenumber <> 7 then l_quantity * length(p_type) end as verified
 from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
 join nation on s_nationkey = n_nationkey)"""

GENDER = "case coalesce(Gender, 'S') when 'U' then 'S' else coalesce(Gender, 'S') end"
MARITAL = "coalesce(MaritalStatus, 'S')"
HOURLY = "case when HoursWorkedPerWeek between 5 and 100 then WeeklyWages / HoursWorkedPerWeek else -1.0 end"
DAILY = "case when DaysWorkedPerWeek > 0 then WeeklyWages / DaysWorkedPerWeek else -1.0 end"
DAYS = "cast(date_diff('day', cast(DateTimeOfAccident as date), DateReported) as int)"
WEEKS = f"cast(least(floor({DAYS} / 7.0), 55) as int)"
CAPPED = "least(UltimateIncurredClaimCost, 1000000.0)"
NUMBER = "cast(substr(ClaimNumber, 3) as bigint)"
YEAR_DELAY = "cast(greatest(least(year(DateReported) - year(DateTimeOfAccident), 1), 0) as int)"
PARTS = {
    "YearOfAccident": "cast(year(DateTimeOfAccident) as int)",
    "MonthOfAccident": "cast(month(DateTimeOfAccident) as int)",
    "DayOfAccident": "cast(day(DateTimeOfAccident) as int)",
    "HourOfAccident": "cast(hour(DateTimeOfAccident) as int)",
    "QuarterOfAccident": "cast(quarter(DateTimeOfAccident) as int)",
    "YearReported": "cast(year(DateReported) as int)",
}
_MARITAL_CODE = f"case {MARITAL} when 'S' then 1 when 'M' then 2 when 'U' then 3 end"
INTERACTIONS = {
    "GenderMarital_int": f"(case {GENDER} when 'M' then 1 when 'F' then 2 when 'S' then 3 end) * ({_MARITAL_CODE})",
    "PartFullMarital_int": f"(case PartTimeFullTime when 'F' then 1 when 'P' then 2 end) * ({_MARITAL_CODE})",
}


def _columns(named: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in named.items())


def _flags() -> dict[str, str]:
    def has(word: str) -> str:
        return f"contains(ClaimDescription, {_str(word)})"

    out = {f"CD_{w}": has(w) for w in text.KEYWORDS}
    out |= {name: has(phrase) for name, phrase in text.PHRASES.items()}
    out["CD_WORKPLACE_STRESS"] = "instr(ClaimDescription, 'WORKPLACE STRESS') > 1 or instr(ClaimDescription, 'STRESS') > 1"
    out["CD_LEFT_RIGHT"] = f"{has('LEFT')} or {has('RIGHT')}"
    return {name: f"cast({sql} as int)" for name, sql in out.items()}


def _collapsed(column: str) -> str:
    return f"trim(regexp_replace({column}, {_str(text.WHITE)}, ' ', 'g'))"


def _tokens(column: str) -> str:
    return f"string_split({_collapsed(column)}, ' ')"


def _word_list() -> list[str]:
    words = list(text.BODY_PARTS)
    words += [w for w in text.BODY_PARTS_ADDED if w not in words]
    return [w for w in words if w not in text.BODY_PARTS_REMOVED]


def _verb_forms() -> dict[str, str]:
    """All forms of the known verbs, written out by inflecting them: form to rank and lemma (``1lift``).

    Where two verbs share a form, the one with a silent e comes first, then the plain one, then the doubled consonant.
    """
    forms = {form: f"1{base}" for form, base in verbs.irregular_forms().items()}
    known = verbs.bases()
    silent = [(b[:-1] + end, b) for end in ("ing", "ed") for b in known if b.endswith("e")]
    plain = [(b + end, b) for end in ("ing", "ed") for b in known]
    doubled = [(b + b[-1] + end, b) for end in ("ing", "ed") for b in known if b[-1] in "bdfglmnprstvz"]
    for form, base in [*silent, *plain, *doubled, *((b[:-1] + "ied", b) for b in known if b.endswith("y"))]:
        forms.setdefault(form, f"1{base}")
    bare = [*((b, b) for b in known), *((b[:-1] + "ies", b) for b in known if b.endswith("y")), *((b + "es", b) for b in known), *((b + "s", b) for b in known)]
    for form, base in bare:
        forms.setdefault(form, f"2{base}")
    return forms


def _document_verbs() -> str:
    forms = ", ".join(f"({_str(f)}, {_str(v)})" for f, v in _verb_forms().items())
    return f"""with f(form, v) as (values {forms}),
w as (select doc_id, unnest(x) as form, unnest(range(len(x))) as place from (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as x from documents)),
h as (select doc_id, place, v[1] as rank, substr(v, 2) as lemma, min(v[1]) over (partition by doc_id) as best from w join f using (form)),
b as (select doc_id, lemma, row_number() over (partition by doc_id order by place) as n, count(*) over (partition by doc_id) as n_verbs from h where rank = best),
g as (select doc_id, max(lemma) filter (n = 1) as verb, max(lemma) filter (n = 2) as second_verb, max(n_verbs) as n_verbs from b group by 1)
select doc_id, verb, second_verb, cast(coalesce(n_verbs, 0) as bigint) as n_verbs from documents left join g using (doc_id)"""


def _features(source: str) -> str:
    """CTEs ``tokenised`` and ``featured``: body parts and causes beside the source's columns."""
    listed = _list(w.upper() for w in _word_list())
    forms = _verb_forms()
    listed_verbs, values = _list(forms), _list(forms.values())
    accident = " or ".join(f"list_contains(toks, {_str(w)})" for w in text.ACCIDENT_WORDS)
    return f"""tokenised as (select *, {_tokens('ClaimDescription')} as toks from {source}),
matched as (
 select *, list_filter({listed}, lambda w: list_contains(toks, w)) as found,
  list_filter(list_transform(toks, lambda w: {values}[list_position({listed_verbs}, lower(w))]), lambda h: h is not null) as hits
 from tokenised),
ranked as (
 select *, list_filter(hits, lambda h: h[1] = list_min(hits)[1]) as best from matched),
featured as (
 select * exclude (toks, found, hits, best),
  coalesce(lower(found[1]), case when contains(ClaimDescription, 'FOREIGN BODY') then 'foreign_body'
   when contains(ClaimDescription, 'TRAUMA') then 'stress' when contains(ClaimDescription, 'CARPEL') then 'wrist'
   when {accident} then 'external' else 'Unknown' end) as BodyParts,
  coalesce(lower(found[2]), 'Unknown') as BodyParts_Minor,
  coalesce(lower(found[3]), 'Unknown') as BodyParts_Minor2,
  case coalesce(substr(best[1], 2), 'Unknown') when 'fell' then 'fall' else coalesce(substr(best[1], 2), 'Unknown') end as CauseOfInjury,
  coalesce(substr(best[2], 2), 'Unknown') as CauseOfInjury_Minor
 from ranked)"""


def _encodings(base: str) -> str:
    """CTEs with kept causes and encodings from the train rows of ``base`` (which has ``loss``)."""
    ctes = [
        f"train as (select * from {base} where split = 'train')",
        "kept as (select CauseOfInjury as k from train group by 1 having count(*) >= 100 and CauseOfInjury <> 'Unknown')",
        f"""grouped as (select * replace (case when CauseOfInjury in (select k from kept) then CauseOfInjury else 'Others' end as CauseOfInjury)
 from {base})""",
        "prior as (select avg(loss) as p from train)",
    ]
    for i, column in enumerate(abt.ENCODINGS):
        ctes.append(
            f"""enc{i} as (select level, p * (1 - w) + m * w as average from
 (select {column} as level, avg(loss) as m, 1 / (1 + exp(-(count(*) - 100.0) / 10.0)) as w from grouped where split = 'train' group by 1), prior)"""
        )
    return ",\n".join(ctes)


def _encoding_joins(source: str) -> str:
    return source + "".join(
        f" left join enc{i} on {source}.{column} = enc{i}.level" for i, column in enumerate(abt.ENCODINGS)
    )


def _encoding_columns() -> str:
    return ", ".join(
        f"round(coalesce(enc{i}.average, (select p from prior)), 6) as {name}" for i, name in enumerate(abt.ENCODINGS.values())
    )


def _noisy_encode() -> str:
    """Encodings times 1 + level * N(0, 1), the normal number drawn from md5 of key, seed and 1 or 2."""
    def uniform(seed: int, n: int) -> str:
        digits = f"substr(md5(ClaimNumber || '|{seed}|{n}'), 1, 13)"
        return f"((cast(('0x' || {digits}) as bigint) + 1.0::double) / {float((1 << 52) + 1)!r}::double)"

    columns = []
    for i, name in enumerate(abt.ENCODINGS.values()):
        normal = f"sqrt(-2 * ln({uniform(SEED + i, 1)})) * cos(2 * pi() * {uniform(SEED + i, 2)})"
        value = f"coalesce(enc{i}.average, (select p from prior))"
        columns.append(f"round({value} * (1 + {NOISE_LEVEL} * {normal}), 6) as {name}")
    return f"""with {CLAIMS}, loss as (select *, ln(1 + {CAPPED}) as loss from claims),
{_features('loss')}, {_encodings('featured')}
select ClaimNumber, split, {', '.join(columns)} from {_encoding_joins('grouped')}"""


def _target_encode(split: str) -> str:
    return f"""with {CLAIMS}, loss as (select *, ln(1 + {CAPPED}) as loss from claims),
{_features('loss')}, {_encodings('featured')}
select ClaimNumber, {_encoding_columns()} from {_encoding_joins('grouped')} where split = '{split}'"""


def _abt(split: str) -> str:
    train = split == "train"
    centred = [
        "Age", "WeeklyWages", "HoursWorkedPerWeek", "HourlyWages", "DaysReportDelay", "ClaimNumberInt",
        "DailyWages", "AnnualWages",
    ]
    rounded = ["InitialIncurredCalimsCost", "LogInitialIncurredCalimsCost", "loss", "InitialIncurred_std", *centred]
    encoded = [*abt.ENCODINGS.values(), "BodyParts_counts"]
    columns = []
    for c in abt.COLUMNS:
        if c == "loss" and not train:
            continue
        if c in encoded:
            continue
        columns.append(f"round({c}, 6) as {c}" if c in rounded else c)
    cost = "InitialIncurredCalimsCost"
    return f"""with {CLAIMS},
dedup as (select distinct * from claims),
low as (select min({cost}) as m from dedup where split = 'test' and {cost} <> 1),
filled as (select * replace ({GENDER} as Gender, {MARITAL} as MaritalStatus,
  case when split = 'test' and {cost} = 1 then (select m from low) else {cost} end as {cost}) from dedup),
derived as (select *, {HOURLY} as HourlyWages, {DAILY} as DailyWages, WeeklyWages * 52 as AnnualWages, {NUMBER} as ClaimNumberInt,
  {_columns(PARTS)}, {DAYS} as DaysReportDelay, {WEEKS} as WeeksReportDelay, {YEAR_DELAY} as YearReportDelay,
  ln(1 + {cost}) as LogInitialIncurredCalimsCost, ln(1 + {CAPPED}) as loss,
  DependentChildren + DependentsOther as TotalDependents, {_columns(INTERACTIONS)}, {_columns(_flags())} from filled),
{_features('derived')}, {_encodings('featured')},
counts as (select BodyParts as level, count(*) as n from train group by 1),
mine as (select * from grouped where split = '{split}'),
q as (select quantile_cont(LogInitialIncurredCalimsCost, 0.95) as q95 from mine),
years as (select YearOfAccident as y, avg({cost}) as ym, stddev_samp({cost}) as ys from mine group by 1),
stats as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in centred)} from mine),
final as (select mine.* replace ({', '.join(f'({c} - m_{c}) / s_{c} as {c}' for c in centred)}),
  cast(CauseOfInjury = 'drive' as int) as CD_drive, cast(CauseOfInjury = 'bend' as int) as CD_bend,
  cast(CauseOfInjury = 'burn' as int) as CD_burn, cast(LogInitialIncurredCalimsCost >= q95 as int) as Severity_Ind,
  cast(cast(LogInitialIncurredCalimsCost >= q95 as int) as varchar) as Severity_Ind_Cat,
  ({cost} - ym) / ys as InitialIncurred_std
 from mine join years on YearOfAccident = y, q, stats)
select {', '.join(columns)}, {_encoding_columns()}, coalesce(counts.n, 1) as BodyParts_counts
from {_encoding_joins('final')} left join counts on final.BodyParts = counts.level"""


def _both(body: str) -> str:
    """A body with {split} marks, once per set."""
    return f"with {CLAIMS}\n" + "\nunion all\n".join(body.replace("{split}", s) for s in ("train", "test"))


def _center() -> str:
    from millrace.operators.encode import CENTRED

    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in CENTRED)
    values = ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) as {c}" for c in CENTRED)
    return f"""with {CLAIMS}, ready as (select * , {HOURLY} as HourlyWages, {DAILY} as DailyWages, WeeklyWages * 52 as AnnualWages,
  {DAYS} as DaysReportDelay, {NUMBER} as ClaimNumberInt from claims),
stats as (select split as s, {stats} from ready group by 1)
select ClaimNumber, {values}, split from ready join stats on split = s"""


def _column_info() -> str:
    fixed = {"int": 4, "float": 4, "date": 4}
    lines = []
    for table, schema in SCHEMAS.items():
        for pos, column in enumerate(schema.split(", "), 1):
            name, kind = column.split(" ")
            if kind == "string":
                width = f"(select max(length({name})) from {table})"
            elif kind.startswith("array"):
                width = f"(select max(len({name})) from {table})"
            else:
                width = str(fixed.get(kind, 8))
            lines.append(
                f"select {_str(table)} as table_name, cast({pos} as int) as position, {_str(name)} as column_name, "
                f"{_str(kind)} as type, cast({width} as bigint) as raw_length"
            )
    return "\nunion all\n".join(lines)


def _table_shape() -> str:
    return "\nunion all\n".join(
        f"select {_str(t)} as table_name, count(*) as n_rows, cast({len(s.split(', '))} as int) as n_columns from {t}"
        for t, s in SCHEMAS.items()
    )


def _register() -> str:
    lines = []
    for t in SCHEMAS:
        ok = len(t) <= 8
        reason = "cast(null as varchar)" if ok else "'longer than 8 characters'"
        rows = f"(select count(*) from {t})" if ok else "cast(null as bigint)"
        lines.append(f"select {_str(t.upper())} as name, {str(ok).lower()} as mapped, {reason} as reason, {rows} as n_rows")
    return "\nunion all\n".join(lines)


def _column_roles() -> str:
    numeric = {
        "Age": 1, "DependentChildren": 1, "DependentsOther": 1, "WeeklyWages": 0, "HoursWorkedPerWeek": 0,
        "DaysWorkedPerWeek": 1, "HourlyWages": 0, "DailyWages": 1, "AnnualWages": 1, "YearOfAccident": 1,
        "MonthOfAccident": 1, "DayOfAccident": 1, "HourOfAccident": 1, "QuarterOfAccident": 1, "YearReported": 1,
        "DaysReportDelay": 1, "WeeksReportDelay": 1, "ClaimNumberInt": 0, "TotalDependents": 1,
        "GenderMarital_int": 1, "PartFullMarital_int": 1,
    }
    texts = {
        "Gender": "coalesce(Gender, 'S')",
        "MaritalStatus": MARITAL,
        "PartTimeFullTime": "PartTimeFullTime",
        "ClaimDescription": "ClaimDescription",
        "WeekdayOfAccident": "dayname(DateTimeOfAccident)",
    }
    order = """Age Gender MaritalStatus DependentChildren DependentsOther WeeklyWages PartTimeFullTime HoursWorkedPerWeek
        DaysWorkedPerWeek ClaimDescription InitialIncurredCalimsCost UltimateIncurredClaimCost HourlyWages DailyWages
        AnnualWages YearOfAccident MonthOfAccident DayOfAccident WeekdayOfAccident HourOfAccident QuarterOfAccident
        YearReported DaysReportDelay WeeksReportDelay ClaimNumberInt LogInitialIncurredCalimsCost TotalDependents
        GenderMarital_int PartFullMarital_int""".split()
    lines = []
    for pos, c in enumerate(order, 1):
        if c in texts:
            n = f"(select count(distinct {texts[c]}) from t)"
            cat, levels = f"{n} <= 25", f"case when {n} <= 25 then {n} end"
        else:
            cat, levels = "false", "cast(null as bigint)"
        lines.append(
            f"select cast({pos} as int) as position, {_str(c)} as column_name, {str(c in numeric).lower()} as is_num, "
            f"{str(bool(numeric.get(c))).lower()} as is_num_nobins, {cat} as is_cat, {levels} as n_levels"
        )
    return f"with {CLAIMS}, t as (select * from claims where split = 'train')\n" + "\nunion all\n".join(lines)


ONE_EFFECT = f"""e as (select activity_desc as level, avg(verified) as m from emissions where year_comp = {YEAR_A} and verified is not null group by 1),
ref as (select level as last, m as b0 from e order by level desc limit 1)"""
ONE_EFFECT_ROWS = f"""with {EMISSIONS}, {ONE_EFFECT}
select 'Intercept' as effect, '' as level, cast(1 as int) as df, round(b0, 6) as estimate from ref
union all
select 'activity_desc', level, cast(level <> last as int), round(m - b0, 6) from e, ref"""
SCORES = f"""with {EMISSIONS}, {ONE_EFFECT}
select l_orderkey, l_linenumber, activity_desc, round(m, 6) as predicted from emissions left join e on activity_desc = level"""


def _model_registry() -> str:
    """Parameters and intercept (the mean of the last level) of the one-effect model of each version."""
    versions = [
        f"""select cast({v} as int) as version, count(*) + 1 as n_parameters, round(max_by(m, level), 6) as intercept
from (select {e} as level, avg(verified) as m from u group by 1)"""
        for v, e in enumerate(REGISTERED, 1)
    ]
    return f"""with {EMISSIONS}, u as (select * from emissions where year_comp = {YEAR_A} and verified is not null)
select 'emissions' as project, 'glm_back' as name, 'register' as action, * from ({' union all '.join(versions)})"""


def _level_totals(effects: list[str]) -> str:
    """The observed totals per level, which a least-squares fit meets; the selected model holds activity_desc alone."""
    levels = [
        f"select '{e}' as effect, {e} as level, count(*) as n, round(sum(verified), 3) as total_predicted from u group by {e}" for e in effects
    ]
    return f"""with {EMISSIONS}, u as (select * from emissions where year_comp = {YEAR_A} and verified is not null)
{' union all '.join(levels)}"""


def _stream_published() -> str:
    """Each row by the mean of its level of the effect that was published last when it arrived."""
    means = " union all ".join(
        f"select {v} as version, {e} as level, avg(verified) as m from u group by {e}" for v, e in enumerate(REGISTERED, 1)
    )
    level = " ".join(f"when {v} then {e}" for v, e in enumerate(REGISTERED, 1))
    return f"""with {EMISSIONS}, u as (select * from emissions where year_comp = {YEAR_A} and verified is not null), means as ({means}),
a as (select *, cast(l_orderkey % 2 + 1 as int) as model_version from emissions)
select l_orderkey, l_linenumber, round(m, 6) as predicted, model_version from a left join means on version = model_version and level = case model_version {level} end"""


def _anova() -> str:
    """Analysis of variance of the selected model, which holds activity_desc alone; its p-value is 0 to two digits."""
    return f"""with {EMISSIONS}, u as (select * from emissions where year_comp = {YEAR_A} and verified is not null),
g as (select activity_desc, count(*) as c, var_pop(verified) * count(*) as css from u group by 1),
s as (select (select count(*) from u) as n, (select count(*) from g) as p, (select sum(css) from g) as sse,
  (select var_pop(verified) * count(*) from u) as tss),
m as (select *, (tss - sse) / (p - 1) as msm, sse / (n - p) as mse from s)
select 'Model' as source, p - 1 as df, round(tss - sse, 2) as ss, round(msm, 2) as ms, round(msm / mse, 2) as f_value, cast(0 as double) as p_value from m
union all select 'Error', n - p, round(sse, 2), round(mse, 2), null, null from m
union all select 'Corrected Total', n - 1, round(tss, 2), null, null, null from m"""


def _simple_steps() -> str:
    """Closed forms for no effect and for each effect alone; both selections end or begin with the best of these on the given tables."""
    single = " union all ".join(
        f"select '{e}' as effects, count(*) as p, sum(css) as sse from (select var_pop(verified) * count(*) as css from u group by {e})" for e in EFFECTS
    )
    return f"""with {EMISSIONS}, u as (select * from emissions where year_comp = {YEAR_A} and verified is not null),
t as (select count(*) as n, var_pop(verified) * count(*) as tss from u),
m as (select '' as effects, 1 as p, tss as sse from t union all select * from ({single})),
s as (select effects, p as n_parameters, n * ln(sse / n) + p * ln(n) as sbc from m, t),
best as (select * from s where effects = '' union all select * from (select * from s where effects <> '' order by sbc limit 1))
select method, effects, cast(n_parameters as int) as n_parameters, round(sbc, 4) as sbc from best, (values ('BACKWARD'), ('FORWARD')) v(method)"""


def _fold_errors() -> str:
    """Each row against the means of the rows of its level in the other four folds."""
    models = []
    for name, e in (("overall mean", "''"), *((f"mean by {e}", e) for e in [*EFFECTS, "city"])):
        models.append(f"""select '{name}' as model, count(*) as n, sqrt(avg((y - coalesce((ts - fs) / nullif(tn - fn, 0), (a.s - b.s) / (a.n - b.n))) ** 2)) as rmse
from (select y, fold, sum(y) over (partition by {e}) as ts, count(*) over (partition by {e}) as tn, sum(y) over (partition by {e}, fold) as fs,
  count(*) over (partition by {e}, fold) as fn from r) join b using (fold), a""")
    digits = "substr(md5(l_orderkey || '|' || l_linenumber), 9, 8)"
    return f"""with {EMISSIONS}, r as (select *, verified as y, cast('0x' || {digits} as bigint) % 5 as fold from emissions where verified is not null),
a as (select sum(y) as s, count(*) as n from r), b as (select fold, sum(y) as s, count(*) as n from r group by 1),
m as ({' union all '.join(models)})
select model, n, round(rmse, 6) as rmse, cast(row_number() over (order by rmse, model) as int) as rank from m"""


def _city_estimates() -> str:
    """Means of the cities beside that of the last one, and what their counts make of the error variance."""
    return f"""with {EMISSIONS},
e as (select city as level, count(*) as n, avg(verified) as m, var_pop(verified) * count(*) as css
  from emissions where year_comp = {YEAR_A} and verified is not null group by 1),
r as (select max(level) as last, max_by(m, level) as b0, max_by(n, level) as n0, sum(css) / (sum(n) - count(*)) as mse from e)
select 'Intercept' as effect, '' as level, cast(1 as int) as df, round(b0, 6) as estimate, round(sqrt(mse / n0), 6) as std_err from r
union all
select 'city', level, cast(level <> last as int), round(m - b0, 6), case when level <> last then round(sqrt(mse * (1.0 / n + 1.0 / n0)), 6) end from e, r"""


def _fit_statistics() -> str:
    stats = {
        "n_read": "n_read",
        "n_used": "n",
        "n_parameters": "p",
        "root_mse": "sqrt(sse / (n - p))",
        "r_square": "1 - sse / tss",
        "adj_r_square": "1 - (n - 1) / (n - p) * (sse / tss)",
        "aic": "n * ln(sse / n) + 2 * p + n + 2",
        "aicc": "n * ln(sse / n) + n * (n + p) / (n - p - 2)",
        "sbc": "n * ln(sse / n) + p * ln(n)",
        "ase": "sse / n",
        "f_value": "((tss - sse) / (p - 1)) / (sse / (n - p))",
    }
    rows = "\nunion all\n".join(f"select {_str(k)} as statistic, round(cast({v} as double), 6) as value from s" for k, v in stats.items())
    return f"""with {EMISSIONS}, y as (select * from emissions where year_comp = {YEAR_A}),
u as (select * from y where verified is not null),
g as (select activity_desc, count(*) as c, var_pop(verified) * count(*) as css from u group by 1),
s as (select (select cast(count(*) as double) from y) as n_read, (select cast(count(*) as double) from u) as n,
  (select cast(count(*) as double) from g) as p, (select sum(css) from g) as sse,
  (select var_pop(verified) * count(*) from u) as tss)
{rows}"""


TOPICS = """topics as (select label, list(m order by pos) as v from (
  select label, pos, avg(x) as m from (
   select label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as pos from embeddings)
  group by 1, 2) group by 1)"""


def _hits(k: int) -> str:
    return f"""{TOPICS}, hits as (select * from (
  select label as question_id, vec_id, score, cast(row_number() over (partition by label order by score desc, vec_id) as int) as rank
  from (select t.label, vec_id, list_dot_product(cast(embedding as double[]), v) as score from embeddings e, topics t)) where rank <= {k})"""


CONTEXTS = f"""with {_hits(3)}, contexts as (
 select question_id, coalesce(string_agg('Document Name: ' || vec_id || chr(10) || 'Content: ' || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank), '') as context
 from hits left join documents on vec_id = doc_id group by 1)"""


def _prompt() -> str:
    from millrace.operators.context import PROMPT

    before, rest = PROMPT.split("{query}")
    middle, after = rest.split("{context}")
    return f"""{CONTEXTS}
select label as question_id, {_str(before)} || 'Which passages are about topic ' || label || '?' || {_str(middle)} || coalesce(context, '') || {_str(after)} as prompt
from topics left join contexts on label = question_id"""


def _flag_query() -> str:
    return f"with {CLAIMS} select ClaimNumber, {_columns(_flags())} from claims"


# Queries without a twin, and what stands in for one.
CERTIFICATES = {
    "glm_fit": "glm_fit_totals",
    "glm_backward": "glm_published_totals, glm_anova",
    "glm_forward": "tests/test_glm.py",
    "automl_leaderboard": "automl_manage, tests/test_text_jobs.py",
    "free_summary": "tests/test_text_jobs.py::test_free_summary_of_documents",
}


def all_sql() -> dict[str, str]:
    claims = f"with {CLAIMS}\n"
    features = f"with {CLAIMS}, {_features('claims')}\n"
    emissions = f"with {EMISSIONS}\n"
    cost = "InitialIncurredCalimsCost"

    def avg_city(year: int, key: str = "city, ") -> str:
        return f"{emissions}select {key}round(avg(verified), 6) as avg_verified from emissions where year_comp = {year} group by city"

    words = _list(_word_list())
    return {
        "csv_roundtrip": f"{claims}select * replace (round({cost}, 6) as {cost}, round(UltimateIncurredClaimCost, 6) as UltimateIncurredClaimCost) from claims",
        "register_tables": _register(),
        "ctas_avg_city": avg_city(YEAR_B),
        "promote_table": "select * replace (round(c_acctbal, 6) as c_acctbal) from customer",
        "sql_text": "select o_orderpriority, count(*) as n_orders, round(avg(o_totalprice), 6) as avg_price from orders where o_orderstatus = 'F' group by 1",
        "column_info": _column_info(),
        "table_shape": _table_shape(),
        "head_n": "select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 5",
        "vector_ingest": "select vec_id as id, text as content, cast(len(embedding) as int) as n_dims, "
        "round(list_sum(cast(embedding as double[])), 6) as vector_sum from embeddings join documents on vec_id = doc_id",
        "vector_ingest_batches": "select vec_id as id, cast(len(embedding) as int) as n_dims, round(list_sum(cast(embedding as double[])), 6) as vector_sum from embeddings",
        "stream_published": _stream_published(),
        "html_items": """select page_id, cast(generate_subscripts(found, 1) - 1 as int) as item_no,
 lower(regexp_replace(unnest(found), '<[^>]*>', '', 'g')) as item
from (select page_id, list_transform(string_split_regex(html, '(?i)<li(\\s[^>]*)?>')[2:],
 lambda x: string_split_regex(x, '(?i)</li[\\s>]|</[uo]l\\s*>')[1]) as found from pages)""",
        "json_props": """select event_id, cast(props->>'$.k' as int) as k, '{"k":' || cast(props->>'$.k' as int) || '}' as encoded from events""",
        "json_items": "select p_partkey, p_partkey as id, p_name as name, p_type as description from part "
        "union all select p_partkey, p_partkey, p_brand, p_type from part",
        "dedup_rows": "select distinct event_type, user_id from events",
        "fill_replace": f"{claims}select ClaimNumber, {GENDER} as Gender, {MARITAL} as MaritalStatus from claims",
        "guarded_wages": f"{claims}select ClaimNumber, round({HOURLY}, 6) as HourlyWages, round({DAILY}, 6) as DailyWages, "
        "round(WeeklyWages * 52, 6) as AnnualWages, DependentChildren + DependentsOther as TotalDependents from claims",
        "drop_prefix": f"{claims}select ClaimNumber, {_columns(PARTS)} from claims",
        "min_impute": f"{claims}, t as (select * from claims where split = 'test') select ClaimNumber, "
        f"round(case when {cost} = 1 then (select min({cost}) from t where {cost} <> 1) else {cost} end, 6) as {cost} from t",
        "clip_rules": f"{claims}select ClaimNumber, {WEEKS} as WeeksReportDelay, {YEAR_DELAY} as YearReportDelay, "
        f"round({CAPPED}, 6) as UltimateIncurredClaimCost from claims",
        "claim_number_int": f"{claims}select ClaimNumber, {NUMBER} as ClaimNumberInt from claims",
        "column_roles": _column_roles(),
        "keyword_flags": _flag_query(),
        "body_parts": f"{features}select ClaimNumber, BodyParts, BodyParts_Minor, BodyParts_Minor2 from featured",
        "cause_of_injury": f"{features}select ClaimNumber, CauseOfInjury, CauseOfInjury_Minor, cast(CauseOfInjury = 'drive' as int) as CD_drive, "
        "cast(CauseOfInjury = 'bend' as int) as CD_bend, cast(CauseOfInjury = 'burn' as int) as CD_burn from featured",
        "document_verbs": _document_verbs(),
        "wordlist_edit": f"{claims}, listed as (select unnest({words}) as word, unnest(range({len(_word_list())})) as position), "
        f"used as (select tok, count(*) as n from (select unnest(list_distinct({_tokens('lower(ClaimDescription)')})) as tok from claims) group by 1) "
        "select cast(position as int) as position, word, coalesce(n, 0) as n_claims from listed left join used on word = tok",
        "date_parts": f"{claims}select ClaimNumber, {_columns(PARTS)}, dayname(DateTimeOfAccident) as WeekdayOfAccident from claims",
        "report_delay": f"{claims}select ClaimNumber, {DAYS} as DaysReportDelay, {WEEKS} as WeeksReportDelay from claims",
        "log_cost": f"{claims}select ClaimNumber, round(ln(1 + {cost}), 8) as LogInitialIncurredCalimsCost, case when split = 'train' then round(ln(1 + {CAPPED}), 8) end as loss from claims",
        "code_interactions": f"{claims}select ClaimNumber, {_columns(INTERACTIONS)} from claims",
        "text_normalize": f"""select doc_id, replace(text, chr(10), ' ') as one_line, {_collapsed('text')} as collapsed, lower(lang) as library,
 upper(substr(source, 1, 1)) || lower(substr(source, 2)) as table_name, to_base64(encode(text)) as encoded from documents""",
        "word_rows": f"""select conv_id, turn, cast(generate_subscripts(toks, 1) - 1 as int) as word_no, unnest(toks) || ' ' as word
from (select conv_id, turn, {_tokens('text')} as toks from conversations where {_collapsed('text')} <> '')""",
        "avg_city_2021": avg_city(YEAR_A),
        "avg_city_2022": avg_city(YEAR_B),
        "avg_only_2022": avg_city(YEAR_B, ""),
        "std_by_year": f"""{claims}, d as (select *, {PARTS['YearOfAccident']} as YearOfAccident from claims),
s as (select split as sp, YearOfAccident as y, avg({cost}) as m, stddev_samp({cost}) as sd from d group by 1, 2)
select ClaimNumber, YearOfAccident, round(({cost} - m) / sd, 6) as InitialIncurred_std, split from d join s on split = sp and YearOfAccident = y""",
        "center_columns": _center(),
        "severity_flag": f"""{claims}, d as (select *, ln(1 + {cost}) as lc from claims),
s as (select split as sp, quantile_cont(lc, 0.95) as q from d group by 1)
select ClaimNumber, cast(lc >= q as int) as Severity_Ind, round(q, 8) as threshold, split from d join s on split = sp""",
        "rare_level": f"""{features}, kept as (select CauseOfInjury as k from featured where split = 'train' group by 1 having count(*) >= 100 and CauseOfInjury <> 'Unknown')
select ClaimNumber, split, case when CauseOfInjury in (select k from kept) then CauseOfInjury else 'Others' end as CauseOfInjury from featured""",
        "encode_noise": _noisy_encode(),
        "target_encode": _target_encode("train"),
        "target_encode_test": _target_encode("test"),
        "frequency_encode": f"""{features}, n as (select BodyParts as b, count(*) as n from featured where split = 'train' group by 1)
select ClaimNumber, split, BodyParts, coalesce(n, 1) as BodyParts_counts from featured left join n on BodyParts = b""",
        "topk_by_task": """select event_type, rank, user_id, downloads from (
 select event_type, user_id, count(*) as downloads, cast(row_number() over (partition by event_type order by count(*) desc, user_id) as int) as rank
 from events group by 1, 2) where rank <= 5""",
        "abt_train": _abt("train"),
        "abt_test": _abt("test"),
        "class_levels": f"""{emissions}, y as (select * from emissions where year_comp = {YEAR_A}),
l as ({' union all '.join(f"select '{e}' as effect, {e} as level, count(*) as n_read, count(verified) as n_used from y where {e} is not null group by {e}" for e in ('country_id', 'nace_desc', 'activity_desc'))})
select *, cast(row_number() over (partition by effect order by level) as int) as level_no, count(*) over (partition by effect) as n_levels from l""",
        "glm_sscp": f"""{emissions}select country_id, nace_desc, activity_desc, cast(grouping(country_id, nace_desc, activity_desc) as bigint) as set_id,
 count(*) as n, round(sum(verified), 3) as sum_y, round(sum(verified * verified), 3) as sum_yy
from emissions where year_comp = {YEAR_A} and verified is not null
group by grouping sets ((), (country_id), (nace_desc), (activity_desc), (country_id, nace_desc), (country_id, activity_desc), (nace_desc, activity_desc))""",
        "glm_one_effect": ONE_EFFECT_ROWS,
        "glm_store": ONE_EFFECT_ROWS,
        "glm_fit_statistics": _fit_statistics(),
        "glm_score": SCORES,
        "stream_score": SCORES,
        "model_registry": _model_registry(),
        "glm_fit_totals": _level_totals(["country_id", "nace_desc", "activity_desc"]),
        "glm_published_totals": _level_totals(["activity_desc"]),
        "glm_simple_steps": _simple_steps(),
        "automl_folds": _fold_errors(),
        "glm_city_estimates": _city_estimates(),
        "glm_city_totals": _level_totals(CITY_EFFECTS),
        "glm_anova": _anova(),
        "automl_manage": f"""{emissions}, f as (select count(*) as n, round(avg(verified), 4) as m from emissions where verified is not null
  and cast('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 8) as bigint) % 10 < 7)
select 'emissions_project' as project, action, version, message, error,
 case when message = 'Publish done' then n end as n_scored, case when message = 'Publish done' then m end as mean_predicted from (values
 ('register', cast(null as int), 'project is not completed: running', cast(null as varchar)), ('publish', null, 'project is not completed: failed', null),
 ('register', 1, 'Register done', null), ('publish', 2, 'Publish done', null),
 ('remove', null, null, 'invalid action; register or publish')) t(action, version, message, error), f""",
        "text_classify": f"""with w as (select doc_id, unnest(regexp_extract_all(lower(text), {_str(WORD)})) as word from documents),
c as (select word, count(*) filter (quality = 1) as one, count(*) filter (quality = 0) as zero from w join labels using (doc_id) group by 1),
t as (select sum(one) as ones, sum(zero) as zeros, count(*) as v from c where one + zero > 0),
b as (select ln((count(*) filter (quality = 1) + 1.0) / (count(*) filter (quality = 0) + 1.0)) as prior from documents join labels using (doc_id)),
s as (select doc_id, sum(ln((one + 1.0) / (ones + v)) - ln((zero + 1.0) / (zeros + v))) as x from w join c using (word), t where one + zero > 0 group by 1),
r as (select doc_id, round(prior + coalesce(x, 0), 9) as odds from documents left join s using (doc_id), b)
select doc_id, case when odds >= 0 then 'positive' else 'negative' end as label, round(1 / (1 + exp(-abs(odds))), 4) as score from r""",
        "extractive_summary": f"""with line as (select doc_id, cast(generate_subscripts(ls, 1) - 1 as int) as line_no, unnest(ls) as line
 from (select doc_id, string_split(text, chr(10)) as ls from documents)),
w as (select doc_id, line_no, word, count(*) as n from (
 select doc_id, line_no, unnest(regexp_extract_all(lower(line), {_str(WORD)})) as word from line) group by 1, 2, 3),
f as (select word, count(distinct doc_id) as df from w group by 1),
tf as (select doc_id, word, sum(n) as n from w group by 1, 2),
d as (select doc_id, sum(n) as total from w group by 1),
s as (select w.doc_id, line_no, round(sum(w.n * (tf.n / total) * ln((1 + (select count(*) from documents)) / (1.0 + df))) / sum(w.n), 9) as score
 from w join f using (word) join tf on tf.doc_id = w.doc_id and tf.word = w.word join d on d.doc_id = w.doc_id group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by score desc, line_no) as place from s),
best as (select r.doc_id, cast(count(*) as int) as n_lines, string_agg('- ' || line, chr(10) order by r.line_no) as summary
from r join line on r.doc_id = line.doc_id and r.line_no = line.line_no where place <= 10 group by 1)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(summary, '') as summary from documents left join best using (doc_id)""",
        "knn_single": """with q as (select list(m order by pos) as v from (select pos, avg(x) as m from (
  select cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as pos from embeddings) group by 1))
select vec_id, round(list_dot_product(cast(embedding as double[]), v), 6) as score, text as content
from embeddings left join documents on vec_id = doc_id, q
order by list_dot_product(cast(embedding as double[]), v) desc, vec_id limit 3""",
        "knn_batch": f"with {_hits(5)} select question_id, vec_id, round(score, 6) as score, rank from hits",
        "knn_by_id": """select question_id, vec_id, round(score, 6) as score, rank from (
 select *, cast(row_number() over (partition by question_id order by score desc, vec_id) as int) as rank
 from (select q.vec_id as question_id, e.vec_id, list_dot_product(cast(e.embedding as double[]), cast(q.embedding as double[])) as score
  from embeddings e join embeddings q on q.vec_id % 20 = 0 and e.vec_id <> q.vec_id)) where rank <= 3""",
        "rag_context": f"{CONTEXTS} select * from contexts",
        "rag_prompt": _prompt(),
        "chat_history": """select conv_id, turn, role, text,
 cast(count(*) over before as bigint) as turns_before,
 cast(coalesce(sum(length(role) + length(text) + 3) over before, 0) as bigint) as chars_before,
 cast(sum(cast(role = 'user' as int)) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as question_no
from conversations window before as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)""",
        "chat_transcript": """select conv_id, cast(floor(turn / 256.0) as bigint) as piece_no, cast(count(*) as int) as n_turns,
 string_agg(role || ': ' || text || chr(10), '' order by turn) as piece_text from conversations group by 1, 2""",
        "token_usage": f"""with t as (select conv_id, role, case when {_collapsed('text')} = '' then 0 else len({_tokens('text')}) end as n from conversations),
s as (select conv_id, cast(sum(case when role = 'assistant' then 0 else n end) as bigint) as prompt_tokens,
 cast(sum(case when role = 'assistant' then n else 0 end) as bigint) as completion_tokens from t group by 1)
select *, prompt_tokens + completion_tokens as total_tokens,
 round(cast((prompt_tokens * 0.0015 + completion_tokens * 0.002) / 1000 as double), 8) as total_cost from s""",
    }
