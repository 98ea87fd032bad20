"""The catalogue of queries over the driver's tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import diff, folds, gates, merge, pairing, rollup, scans
from ..schema import DEFAULT_MODELS, SOURCES
from ..sources import conversations as conv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.sessions(table(spark, sf_dir, "conversations"))


_LIST = "[" + ", ".join(f"'{s}'" for s in SOURCES) + "]"
_NAMED = f"""cast(conv_id as varchar) as session_id, list_extract({_LIST}, cast(conv_id % 9 + 1 as int)) as source,
 concat(list_extract({_LIST}, cast(conv_id % 9 + 1 as int)), ':Proj_', conv_id % 7) as project, concat('vendor/Model_', conv_id % 5, '.0') as model"""
SESSIONS_SQL = f"""select conv_id, count(*) filter (role = 'user') as user_messages, count(*) filter (role = 'assistant') as assistant_messages,
 cast(coalesce(sum(length(text)) filter (role = 'user'), 0) as bigint) as input_tokens,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as output_tokens, {_NAMED} from conversations group by conv_id"""
_MODEL_KEY = "nullif(translate(regexp_extract(trim(model), '[^/]*$'), '_.', '--'), '')"
_PROJECT_KEY = "nullif(translate(lower(regexp_replace(trim(project), '^[^:]*:', '')), '_.', '--'), '')"
_SUMS = "count(*) as sessions, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens"


@query(f"with s as ({SESSIONS_SQL}) select {_MODEL_KEY} as model, {_SUMS} from s group by 1 order by output_tokens desc, model")
def session_rollup_by_model(spark, sf_dir):
    return rollup.ordered(rollup.by_model(_sessions(spark, sf_dir)), "model")


@query(f"with s as ({SESSIONS_SQL}) select {_PROJECT_KEY} as project, {_SUMS} from s group by 1 order by output_tokens desc, project")
def session_rollup_by_project(spark, sf_dir):
    return rollup.ordered(rollup.by_project(_sessions(spark, sf_dir)), "project")


@query(
    f"""with s as ({SESSIONS_SQL}), k as (select {_MODEL_KEY} as m, {_PROJECT_KEY} as p, input_tokens, output_tokens from s)
select 'model' as kind, m as key, {_SUMS} from k group by m union all select 'project', p, {_SUMS} from k group by p union all select 'total', null, {_SUMS} from k"""
)
def export_summary_grouping_sets(spark, sf_dir):
    return rollup.summary(_sessions(spark, sf_dir))


@query(
    f"""with s as ({SESSIONS_SQL}), raw as (select concat(source, '/', model) as name, count(*) as sessions, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens from s group by 1)
select nullif(translate(regexp_extract(trim(name), '[^/]*$'), '_.', '--'), '') as model, cast(sum(sessions) as bigint) as sessions,
 cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens from raw group by 1"""
)
def breakdown_renormalized(spark, sf_dir):
    raw = rollup.breakdown(_sessions(spark, sf_dir), F.concat_ws("/", "source", "model"), "name")
    return rollup.renormalized(raw, S.model_key(F.col("name")), "model")


@query(f"select session_id, source, user_messages, assistant_messages, input_tokens, output_tokens from ({SESSIONS_SQL}) where user_messages + assistant_messages > 0")
def session_stats(spark, sf_dir):
    return _sessions(spark, sf_dir).where("user_messages + assistant_messages > 0").select("session_id", "source", "user_messages", "assistant_messages", "input_tokens", "output_tokens")


@query("select user_id, first(event_type order by ts, event_id) as start_time, last(event_type order by ts, event_id) as end_time from events where event_type is not null group by user_id")
def time_bounds_first_last(spark, sf_dir):
    return folds.first_last(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(f"with s as ({SESSIONS_SQL}), m as (select session_id, case conv_id % 6 when 0 then null when 1 then '' when 2 then '<synthetic>' else model end as model from s) select session_id, model from m where model is not null and model not in ('', '<synthetic>')")
def skip_synthetic_models(spark, sf_dir):
    odd = F.when(F.col("conv_id") % 6 == 1, "").when(F.col("conv_id") % 6 == 2, "<synthetic>").when(F.col("conv_id") % 6 != 0, F.col("model"))
    return gates.with_model(_sessions(spark, sf_dir).withColumn("model", odd)).select("session_id", "model")


_DEFAULTS = " ".join(f"when '{k}' then '{v}'" for k, v in DEFAULT_MODELS.items())


@query(f"with s as ({SESSIONS_SQL}) select session_id, coalesce(case when conv_id % 2 = 0 then nullif('', '') else model end, case source {_DEFAULTS} end) as model from s")
def default_models(spark, sf_dir):
    return gates.with_default_model(_sessions(spark, sf_dir).withColumn("model", F.when(F.col("conv_id") % 2 == 0, "").otherwise(F.col("model")))).select("session_id", "model")


@query(f"select session_id from ({SESSIONS_SQL}) where source = 'codex'")
def source_filter(spark, sf_dir):
    return gates.of_source(_sessions(spark, sf_dir), "codex").select("session_id")


@query(f"select session_id, project from ({SESSIONS_SQL}) where project not in ('claude:Proj_0', 'gemini:Proj_3', 'kimi:Proj_6')")
def project_exclusion(spark, sf_dir):
    return gates.without_projects(_sessions(spark, sf_dir), ["claude:Proj_0", "gemini:Proj_3", "kimi:Proj_6"]).select("session_id", "project")


_CALLS = """c as (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as call from events where event_type = 'click'),
r as (select user_id, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as call from events where event_type = 'purchase')"""


def _calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    up, down = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    calls = e.where("event_type = 'click'").select("user_id", "event_id", F.row_number().over(up).cast("long").alias("call"))
    results = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("result_id"), "value", F.row_number().over(down).cast("long").alias("call"))
    return calls, results


@query(f"with {_CALLS} select c.user_id, c.call, c.event_id, r.value as output from c left join r using (user_id, call)")
def tool_call_pairing_left_join(spark, sf_dir):
    calls, results = _calls(spark, sf_dir)
    return pairing.pair_calls(calls, results, ["user_id", "call"], "result_id", "value").select("user_id", "call", "event_id", "output")


@query(f"with {_CALLS} select r.user_id, r.call, r.event_id as result_id from r anti join c using (user_id, call)")
def orphan_results_anti(spark, sf_dir):
    calls, results = _calls(spark, sf_dir)
    return pairing.orphan_results(calls, results, ["user_id", "call"]).select("user_id", "call", "result_id")


@query(
    """with c as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'click'),
r as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events where event_type = 'purchase')
select c.user_id, c.n, c.event_id, r.event_id as result_event_id from c left join r using (user_id, n)"""
)
def fifo_pairing_by_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda kind: e.where(F.col("event_type") == kind).select("user_id", "event_id")
    return pairing.pair_fifo(pick("click"), pick("purchase"), ["user_id"], "event_id")


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


_NOISE = " and ".join(f"not contains(match, '{x}')" for x in scans.EMAIL_NOISE)


def _matches_sql(kind: str, group: int = 0, where: str = "true", source: str = "documents") -> str:
    return f"select doc_id, match from (select doc_id, unnest(regexp_extract_all(text, '{scans.PII_PATTERNS[kind]}', {group})) as match from {source}) where {where}"


#: Documents with keys made from their ids at the end, since the tables hold none: every second has a token, every third
#: a key with one of the prefixes, every fifth the one that is no key.
_KEYED_SQL = """(select doc_id, concat(coalesce(text, ''), case when doc_id % 2 = 0 then concat(' eyJ', md5(cast(doc_id as varchar))) else '' end,
case when doc_id % 3 = 0 then concat(' ', list_extract(['ghp_', 'sk-', 'hf_'], cast(doc_id % 7 % 3 + 1 as int)), substr(md5(cast(doc_id as varchar)), 1, 16)) else '' end, case when doc_id % 5 = 0 then ' sk-notification' else '' end) as text from documents)"""


def _keyed(spark, sf_dir):
    code, when = F.md5(F.col("doc_id").cast("string")), lambda n, c: F.when(F.col("doc_id") % n == 0, c).otherwise("")
    prefix = F.element_at(F.array(*[F.lit(p) for p in ("ghp_", "sk-", "hf_")]), (F.col("doc_id") % 7 % 3 + 1).cast("int"))
    keys = when(2, F.concat(F.lit(" eyJ"), code)), when(3, F.concat(F.lit(" "), prefix, F.substring(code, 1, 16))), when(5, F.lit(" sk-notification"))
    return _texts(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), *keys))


@query(_matches_sql("emails", 0, _NOISE))
def pii_emails(spark, sf_dir):
    return scans.matches(_texts(spark, sf_dir), "text", "emails")


@query(_matches_sql("ip_addresses"))
def pii_ips(spark, sf_dir):
    return scans.matches(_texts(spark, sf_dir), "text", "ip_addresses")


@query(_matches_sql("jwt_tokens", source=_KEYED_SQL))
def pii_jwt(spark, sf_dir):
    return scans.matches(_keyed(spark, sf_dir), "text", "jwt_tokens")


@query(_matches_sql("api_keys", 1, source=_KEYED_SQL))
def pii_api_keys_prefix(spark, sf_dir):
    return scans.matches(_keyed(spark, sf_dir), "text", "api_keys", whole=False)


@query(_matches_sql("api_keys", 0, "match <> 'sk-notification'", _KEYED_SQL))
def pii_api_keys_full(spark, sf_dir):
    return scans.matches(_keyed(spark, sf_dir), "text", "api_keys")


#: Fixed value: matches that are no finding, by kind.
_KEPT_MATCHES = {"emails": _NOISE, "api_keys": "match <> 'sk-notification'"}


@query(
    "select kind, string_agg(match, '|' order by match) as matches from (select kind, match, row_number() over (partition by kind order by match) as r from (select distinct kind, match from ("
    + " union all ".join(f"select '{k}' as kind, match from ({_matches_sql(k, 0, _KEPT_MATCHES.get(k, 'true'), _KEYED_SQL)})" for k in scans.PII_PATTERNS)
    + "))) where r <= 20 group by kind"
)
def pii_summary_top20(spark, sf_dir):
    return scans.pii_summary(_keyed(spark, sf_dir), "text").select("kind", F.array_join("matches", "|").alias("matches"))


_ENTROPY = "list_sum(list_transform(list_distinct(string_split(token, '')), lambda c: -((length(token) - length(replace(token, c, ''))) / length(token)) * log2((length(token) - length(replace(token, c, ''))) / length(token))))"


@query(f"with t as (select doc_id, unnest(list_distinct(regexp_extract_all(text, '{scans.CANDIDATE}'))) as token from documents) select doc_id, token, round({_ENTROPY}, 6) as entropy from t")
def entropy_candidates(spark, sf_dir):
    return scans.candidates(_texts(spark, sf_dir), "text").select("doc_id", "token", F.round(S.shannon_entropy(F.col("token")), 6).alias("entropy"))


def _tokens(spark, sf_dir):
    token = F.regexp_replace(F.base64(F.unhex(F.concat(F.md5("c_name"), F.substring(F.md5(F.reverse("c_name")), 1, 16)))), "[=+]", "x")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line"), F.concat(F.lit("key "), token, F.lit(" end")).alias("text"))


def _suspicious_sql() -> str:
    parts = ["length(token) <= 512", "not regexp_matches(token, '^[0-9a-fA-F]+$')", f"not regexp_matches(token, '{scans.UUID}')"]
    parts.append("cast(regexp_matches(token, '[a-z]') as int) + cast(regexp_matches(token, '[A-Z]') as int) + cast(regexp_matches(token, '[0-9]') as int) >= 2")
    parts += [f"not starts_with(token, '{p}')" for p in scans.KNOWN_PREFIXES] + [f"not contains(lower(token), '{e}')" for e in scans.FILE_EXTENSIONS]
    parts += ["length(token) - length(replace(token, '/', '')) < 2", "length(token) - length(replace(token, '.', '')) < 3"]
    parts += [f"not starts_with(lower(token), '{p}')" for p in scans.BENIGN_PREFIXES] + [f"not contains(lower(token), '{p}')" for p in scans.BENIGN_PARTS]
    return " and ".join(parts)


@query(
    f"""with k as (select c_custkey as line, concat('key ', regexp_replace(to_base64(unhex(concat(md5(c_name), substr(md5(reverse(c_name)), 1, 16)))), '[=+]', 'x', 'g'), ' end') as text from customer),
t as (select line, text, unnest(list_distinct(regexp_extract_all(text, '{scans.CANDIDATE}'))) as token from k),
e as (select line, text, token, {_ENTROPY} as h from t where {_suspicious_sql()})
select token as match, round(h, 2) as entropy, line, text as context from e where h >= 4.0 order by entropy desc, line, match limit 15"""
)
def high_entropy_top15(spark, sf_dir):
    return scans.high_entropy(_tokens(spark, sf_dir), "text", "line")


@query("select c_custkey, concat('user_', substr(sha256(c_name), 1, 8)) as user from customer")
def username_hash(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.user_hash(F.col("c_name")).alias("user"))


@query(
    "select c_custkey, regexp_replace(concat('path /home/', lower(c_name), '/x by ', upper(c_name), '.'), concat('(^|[^a-zA-Z0-9])', regexp_replace(lower(c_name), '([^a-z0-9])', '\\\\\\1', 'g'), '([^a-zA-Z0-9]|$)'), concat('\\1user_', substr(sha256(lower(c_name)), 1, 8), '\\2'), 'gi') as text from customer"
)
def anonymize_usernames(spark, sf_dir):
    from ..operators.anonymize import anonymize_by_column

    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("path /home/"), F.lower("c_name"), F.lit("/x by "), F.upper("c_name"), F.lit("."))
    return c.select("c_custkey", anonymize_by_column(text, F.lower("c_name")).alias("text"))


@query("select doc_id from documents where contains(lower(text), 'naïve enän') or contains(lower(strip_accents(text)), 'en')")
def name_scan_lines(spark, sf_dir):
    return scans.name_lines(_texts(spark, sf_dir), "text", "ên").select("doc_id")


@query("select doc_id as line, case when length(trim(text, e' \\n\\t\\r')) > 220 then concat(rtrim(substr(trim(text, e' \\n\\t\\r'), 1, 220), e' \\n\\t\\r'), '...') else trim(text, e' \\n\\t\\r') end as excerpt from documents where contains(lower(text), 'licensed') order by line limit 5")
def text_occurrences_top5(spark, sf_dir):
    return scans.occurrences(_texts(spark, sf_dir), "text", "Licensed", "doc_id")


# Two versions of a dataset of sessions, cut from the conversations: some only there, some only here, some longer here.
def _sides(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    side = lambda rows: conv.named(
        rows.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.max("turn").cast("string").alias("end_time"))
    ).select(F.concat_ws("/", "source", "session_id").alias("key"), "n_messages", "n_bytes", "end_time", F.col("conv_id").alias("line"), F.md5(F.concat_ws("|", F.col("conv_id"), F.col("n_messages"), F.col("n_bytes"))).alias("digest"))
    remote = side(t.where("conv_id % 5 <> 0").where("conv_id % 3 <> 0 or turn < 3"))
    local = side(t.where("conv_id % 3 <> 1"))
    return remote, local


_SIDE = f"""select concat(source, '/', session_id) as key, n_messages, n_bytes, end_time, conv_id as line, md5(concat_ws('|', conv_id, n_messages, n_bytes)) as digest from
 (select conv_id, count(*) as n_messages, cast(sum(strlen(text)) as bigint) as n_bytes, cast(max(turn) as varchar) as end_time, {_NAMED} from conversations where {{}} group by conv_id)"""
_SIDES = f"r as ({_SIDE.format('conv_id % 5 <> 0 and (conv_id % 3 <> 0 or turn < 3)')}), l as ({_SIDE.format('conv_id % 3 <> 1')})"
_MERGED = f"""with {_SIDES}, b as (select *, 0 as side from r union all select *, 1 from l),
m as (select *, max(cast(side = 0 as int)) over w as rr, max(cast(side = 1 as int)) over w as ll, row_number() over (partition by key order by n_messages desc, n_bytes desc, end_time desc, side, line) as k from b window w as (partition by key)),
x as (select key, n_messages, n_bytes, end_time, line, case when rr = 0 then 'added' when ll = 0 then 'carried_forward' when side = 1 then 'updated' else 'unchanged' end as merge_class from m where k = 1)"""


@query(f"{_MERGED} select * from x")
def union_merge_winners(spark, sf_dir):
    return merge.union_merge(*_sides(spark, sf_dir)).select("key", "n_messages", "n_bytes", "end_time", "line", "merge_class")


@query(f"{_MERGED} select count(*) filter (merge_class = 'added') as added, count(*) filter (merge_class = 'updated') as updated, count(*) filter (merge_class = 'carried_forward') as carried_forward, count(*) filter (merge_class = 'unchanged') as unchanged, count(*) as total from x")
def union_merge_stats(spark, sf_dir):
    return merge.merge_stats(merge.union_merge(*_sides(spark, sf_dir)))


@query(f"with {_SIDES} select key from r anti join l using (key)")
def carry_forward_anti(spark, sf_dir):
    remote, local = _sides(spark, sf_dir)
    return remote.join(local, "key", "left_anti").select("key")


@query(f"with {_SIDES}, ch as (select key from (select key, digest, 1 as d from l union all select key, digest, -1 from r) group by key, digest having sum(d) <> 0) select key, line from l semi join ch using (key)")
def changed_keys_semi(spark, sf_dir):
    remote, local = _sides(spark, sf_dir)
    return local.join(diff.changed_keys(remote, local, "key", "digest"), "key", "left_semi").select("key", "line")


def _versions(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.md5("text").alias("digest"), F.col("doc_id").alias("line"))
    return d.where("line % 4 <> 0"), d.where("line % 4 <> 1")


_VERSIONS = "o as (select source as key, md5(text) as digest, doc_id as line from documents where doc_id % 4 <> 0), n as (select source as key, md5(text) as digest, doc_id as line from documents where doc_id % 4 <> 1)"
_DIFFERENCE = f"""{_VERSIONS}, dd as (select key, digest, sum(d) as d from (select key, digest, 1 as d from n union all select key, digest, -1 from o) group by key, digest having sum(d) <> 0)"""


@query(f"with {_DIFFERENCE} select key, digest, cast(greatest(-d, 0) as bigint) as removed, cast(greatest(d, 0) as bigint) as added from dd")
def multiset_diff(spark, sf_dir):
    return diff.multiset_difference(*_versions(spark, sf_dir), "key", "digest")


_EVENTS = f"""with {_DIFFERENCE},
g as (select key, digest, line, row_number() over (partition by key order by digest, line) as n from (select o.key, o.digest, line, -d as c, row_number() over (partition by o.key, o.digest order by line desc) as k from o join dd using (key, digest) where d < 0) where k <= c),
h as (select key, digest, line, row_number() over (partition by key order by digest, line) as n from (select n.key, n.digest, line, d as c, row_number() over (partition by n.key, n.digest order by line desc) as k from n join dd using (key, digest) where d > 0) where k <= c),
ev as (select key, n, g.digest as removed_digest, g.line as removed_line, h.digest as added_digest, h.line as added_line, case when g.digest is null then 'added' when h.digest is null then 'removed' else 'modified' end as event from g full join h using (key, n))"""


@query(f"{_EVENTS} select * from ev")
def diff_pairs(spark, sf_dir):
    return diff.events(*_versions(spark, sf_dir))


@query(f"{_EVENTS} select count(*) filter (event = 'modified') as modified, count(*) filter (event = 'removed') as removed, count(*) filter (event = 'added') as added, count(distinct key) as changed_keys, (select count(*) from n anti join dd using (key)) as unchanged_records from ev")
def diff_classes(spark, sf_dir):
    return diff.diff_summary(*_versions(spark, sf_dir))


@query("select doc_id, md5(text) as digest from (select *, row_number() over (partition by text order by doc_id) as r from documents) where r = 1")
def first_seen_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    return merge.first_seen(rows, "digest", ["doc_id"])


@query("with f as (select conv_id, role, min(turn) as t from conversations where trim(role) <> '' group by conv_id, role) select conv_id, string_agg(role, ',' order by t) as roles from f group by conv_id")
def ordered_distinct_thinking(spark, sf_dir):
    return folds.ordered_distinct(table(spark, sf_dir, "conversations"), "conv_id", "role", ["turn"]).select("conv_id", F.array_join("values", ",").alias("roles"))


@query("with t as (select *, coalesce(sum(cast(event_type = 'error' as int)) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as turn from events) select user_id, cast(turn as bigint) as turn, count(*) as events, min(event_id) as first_event, max(event_id) as last_event from t group by user_id, turn")
def turn_islands(spark, sf_dir):
    rows = folds.turns(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return rows.groupBy("user_id", "turn").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("select user_id, max(value) as value, max(event_id) as event_id from events group by user_id")
def cumulative_max_tokens(spark, sf_dir):
    return folds.cumulative_max(table(spark, sf_dir, "events"), "user_id", ["value", "event_id"])


@query("select user_id, min(event_id) as position, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value from events group by user_id")
def upsert_log_fold(spark, sf_dir):
    rows = folds.upsert_log(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], ["event_type", "value"])
    return rows.select("user_id", F.col("position.event_id").alias("position"), "event_type", "value")


@query("with s as (select conv_id, count(*) as n from conversations group by conv_id) select conv_id, n, cast(floor(1000000 * n / (select sum(n) from s)) as bigint) as estimated_bytes from s")
def proportional_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return rollup.proportional(rows, "n", F.lit(1_000_000), "estimated_bytes")


@query("select lang as source, source as project, count(*) as session_count, cast(sum(strlen(text)) as bigint) as total_size_bytes from documents group by all order by project, source")
def project_catalog(spark, sf_dir):
    files = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("source").alias("project"), F.octet_length("text").cast("long").alias("bytes"))
    return rollup.project_catalog(files)


@query(
    """with p as (select page_id, string_split(url, '/') as parts from pages), x as (select page_id, unnest(list_transform(range(1, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/'))) as prefix from p),
w as (select distinct regexp_extract(url, '^[a-z]+://[^/]+') as site from pages), h as (select sha256(site) as hash, site from w)
select page_id, h.hash, h.site from x join h on sha256(x.prefix) = h.hash"""
)
def reverse_hash_lookup(spark, sf_dir):
    from ..operators.paths import prefixes, resolve_hashes

    pages = table(spark, sf_dir, "pages")
    known = pages.select(F.regexp_extract("url", "^[a-z]+://[^/]+", 0).alias("site")).distinct().select(F.sha2("site", 256).alias("hash"))
    found = resolve_hashes(known, prefixes(pages.select("page_id", "url"), "url"), "hash", "prefix")
    return found.select("page_id", "hash", F.col("prefix").alias("site"))


@query("select p_partkey, concat('codex:', list_extract(list_filter(string_split(replace(p_name, ' ', '/'), '/'), lambda x: x <> ''), -1)) as project from part")
def project_of_cwd(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.project_of_path(F.replace("p_name", F.lit(" "), F.lit("/")), "codex").alias("project"))


@query(
    """with e as (select p_partkey, string_split(replace(p_name, ' ', '-'), '-') as w, case p_partkey % 3 when 0 then ['Users', 'ann', 'Documents'] when 1 then ['home', 'bob'] else [] end as lead from part)
select p_partkey, array_to_string(w, '-') as project from e"""
)
def project_name_decode(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    lead = F.when(F.col("p_partkey") % 3 == 0, "-Users-ann-Documents-").when(F.col("p_partkey") % 3 == 1, "-home-bob-").otherwise("")
    return p.select("p_partkey", S.project_of_encoded_dir(F.concat(lead, F.replace("p_name", F.lit(" "), F.lit("-")))).alias("project"))


@query("select doc_id, case when length(trim(text, e' \\n\\t\\r')) > 220 then concat(rtrim(substr(trim(text, e' \\n\\t\\r'), 1, 220), e' \\n\\t\\r'), '...') else trim(text, e' \\n\\t\\r') end as excerpt from documents")
def excerpt_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.excerpt(F.col("text")).alias("excerpt"))


@query("select doc_id, case when n * n < 1024 then concat(n * n, ' B') when n * n < 1048576 then printf('%.1f KB', n * n / 1024.0) when n * n < 1073741824 then printf('%.1f MB', n * n / 1048576.0) else printf('%.1f GB', n * n / 1073741824.0) end as size from (select doc_id, n_chars as n from documents)")
def size_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.format_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query("select doc_id, case when n >= 1000000000 then printf('%.1fB', n / 1e9) when n >= 1000000 then printf('%.1fM', n / 1e6) when n >= 1000 then printf('%.0fK', n / 1e3) else cast(n as varchar) end as tokens from (select doc_id, n_chars * (doc_id + 7) + 1 as n from documents)")
def token_format(spark, sf_dir):
    n = F.col("n_chars") * (F.col("doc_id") + 7) + 1
    rows = table(spark, sf_dir, "documents").select("doc_id", n.alias("n"))
    return rows.select("doc_id", S.format_tokens(F.col("n")).alias("tokens"))


@query(f"select session_id, case when conv_id % 2 = 0 then 'kept' else 'redacted' end as action from ({SESSIONS_SQL})")
def policy_stamp_skip(spark, sf_dir):
    rows = _sessions(spark, sf_dir).withColumn("redaction_policy", F.when(F.col("conv_id") % 2 == 0, "p1"))
    return rows.select("session_id", gates.by_stamp(F.lit("p1"), F.lit("kept"), F.lit("redacted")).alias("action"))


@query(
    """with c as (select source, count(*) as prior, count(*) filter (doc_id % 23 <> 0) as now from documents group by source)
select source, prior, now, case when now >= prior then false when prior <= 20 then true else (prior - now) / prior >= 0.05 end as blocked from c"""
)
def shrink_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("prior"), F.count_if(F.col("doc_id") % 23 != 0).alias("now"))
    return d.select("source", "prior", "now", gates.shrunk(F.col("prior"), F.col("now")).alias("blocked"))


@query(
    """with l as (select source, list(distinct lang) as a, list(distinct lang) filter (doc_id % 3 <> 0) as b from documents group by source)
select source, array_to_string(list_sort(a), ',') <> coalesce(array_to_string(list_sort(b), ','), '') and coalesce(len(b), 0) < len(a) as drifted from l"""
)
def drift_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("a"), F.collect_set(F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).alias("b"))
    return d.select("source", gates.drifted(F.col("a"), F.col("b")).alias("drifted"))


@query("select source, sha256(concat(array_to_string(list_transform(list_sort(list(distinct lang)), lambda x: concat(x, chr(0))), ''))) as fingerprint from documents group by source")
def policy_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(S.set_fingerprint(F.collect_set("lang")).alias("fingerprint"))


@query("select event_id, json_extract_string(props, '$.k') as k, json_type(props) = 'OBJECT' as is_object from events")
def json_props_extract(spark, sf_dir):
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.schema_of_variant(v).startswith("OBJECT").alias("is_object"))


@query("select doc_id, sha256(concat_ws('|', 'email', lang)) as fingerprint from documents")
def finding_fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.finding_fingerprint(F.lit("email"), F.col("lang")).alias("fingerprint"))


@query(
    f"""with f as (select sha256(concat_ws('|', 'ip', match)) as fp, match, doc_id from ({_matches_sql('ip_addresses')}))
select fp as fingerprint, any_value(match) as text, count(*) as n, min(doc_id) as first_seen, max(doc_id) as last_seen from f group by fp"""
)
def finding_registry(spark, sf_dir):
    from ..operators.findings import registry

    found = scans.matches(_texts(spark, sf_dir), "text", "ip_addresses").select(F.lit("ip").alias("entity"), F.col("match").alias("text"), F.col("doc_id").alias("seen"))
    return registry(found).select("fingerprint", "text", "n", "first_seen", "last_seen")


@query(
    "select doc_id, regexp_replace(regexp_replace(text, '"
    + scans.PII_PATTERNS["emails"]
    + "', '[REDACTED]', 'g'), '"
    + scans.PII_PATTERNS["ip_addresses"]
    + "', '[REDACTED]', 'g') as text, len(regexp_extract_all(text, '"
    + scans.PII_PATTERNS["emails"]
    + "')) + len(regexp_extract_all(regexp_replace(text, '"
    + scans.PII_PATTERNS["emails"]
    + "', '[REDACTED]', 'g'), '"
    + scans.PII_PATTERNS["ip_addresses"]
    + "')) as redactions from documents"
)
def redact_emails_and_ips(spark, sf_dir):
    from ..operators.redact import redact_patterns

    text, n = redact_patterns(F.col("text"), [scans.PII_PATTERNS["emails"], scans.PII_PATTERNS["ip_addresses"]])
    return _texts(spark, sf_dir).select("doc_id", text.alias("text"), n.cast("long").alias("redactions"))


@query("select strftime(time_bucket(interval '1 hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as events, round(sum(value), 4) as total from events group by all")
def tumbling_window_counts(spark, sf_dir):
    from ..streaming.windows import tumbling

    rows = tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", "total")


@query("select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, count(*) as events from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as s from events) group by s")
def sliding_window_counts(spark, sf_dir):
    from ..streaming.windows import sliding

    rows = sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "30 minutes", [], F.count("*").alias("events"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "events")


@query(
    """with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts, event_id) > ts - interval '30 minutes' then 0 else 1 end as b from events),
s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as s from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, count(*) as events from s group by user_id, s"""
)
def session_window_counts(spark, sf_dir):
    from ..streaming.windows import sessions

    rows = sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"], F.count("*").alias("events"))
    return rows.select("user_id", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "events")


@query(
    """select n_name, date_part('year', o_orderdate) as year, count(*) as lines, cast(sum(cast(l_extendedprice * (1 - l_discount) as decimal(18, 4))) as double) as revenue
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where l_shipdate >= timestamp '1995-01-01' group by all"""
)
def revenue_by_nation_year(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp '1995-01-01'").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"))
    per_order = line.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("revenue").alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("year"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # 25 rows at any scale.
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    rows = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name", "year").agg(F.sum("lines").alias("lines"), F.sum("revenue").cast("double").alias("revenue"))


@query()
def redact_secrets(spark, sf_dir):
    from ..operators.redact import redact_column

    return redact_column(_texts(spark, sf_dir), "text").select("doc_id", "text", "redactions")


@query()
def json_patch_diff(spark, sf_dir):
    from ..functions.json_values import patch_udf

    t = table(spark, sf_dir, "conversations")
    record = lambda rows: rows.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("turn", "role", "text")))).alias("j"))
    a, b = record(t.where("turn < 4")), record(t)
    both = a.join(b.withColumnRenamed("j", "k"), "conv_id")
    return both.select("conv_id", patch_udf("j", "k").alias("patch"))


_EDITED = "turn % 7 = 3"
_DROPPED = "turn % 5 = 4"


@query(
    f"""select conv_id, count(*) filter ({_EDITED} and not {_DROPPED} and text is not null) as replaced, count(*) filter ({_DROPPED}) as removed, cast(1 as bigint) as added
from conversations group by conv_id"""
)
def message_patch_counts(spark, sf_dir):
    """Sessions in which some messages were edited, some dropped and one added: what their patches consist of."""
    from ..functions.json_values import patch_udf

    message = F.struct(F.format_string("%09d", "turn").alias("timestamp"), "role", "content")
    edited = message.withField("content", F.when(F.expr(_EDITED), F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content")))
    t = table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")
    last = F.array(F.struct(F.lit("999999999").alias("timestamp"), F.lit("user").alias("role"), F.lit("added").alias("content")))
    kept = F.collect_list(F.when(~F.expr(_DROPPED), edited))
    sessions = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(message)).alias("old"), F.concat(F.sort_array(kept), last).alias("new"))
    as_json = lambda c: F.to_json(F.struct(F.col(c).alias("messages")), {"ignoreNullFields": "false"})
    ops = F.from_json(patch_udf(as_json("old"), as_json("new")), "array<struct<op:string>>")["op"]
    many = lambda op: F.size(F.filter(ops, lambda x: x.startswith(op))).cast("long")  # noqa: E731  # replace, or replace_text
    return sessions.select("conv_id", many("replace").alias("replaced"), many("remove").alias("removed"), many("add").alias("added"))


@query()
def canonical_hash(spark, sf_dir):
    from ..functions.json_values import canonical_udf

    e = table(spark, sf_dir, "events").select("event_id", canonical_udf("props").alias("canonical"))
    return e.withColumn("digest", F.sha2("canonical", 256))


@query()
def yaml_render(spark, sf_dir):
    from ..sinks.yaml_text import yaml_udf

    rows = conv.messages(table(spark, sf_dir, "conversations")).select("session_id", F.to_json(F.struct("session_id", "model", "role", "text")).alias("j"))
    return rows.select("session_id", yaml_udf("j").alias("yaml"))


@query()
def unified_text_diff(spark, sf_dir):
    from ..functions.json_values import unified_diff_udf

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", unified_diff_udf(F.col("text"), F.concat(F.col("text"), F.lit("\nlast line"))).alias("diff"))


def _claude_lines(t: DataFrame) -> DataFrame:
    """Turns of conversations as lines of a claude log: conv_id, turn, value."""
    said = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")))).otherwise(F.to_json(F.struct(F.col("text").alias("content"))))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","timestamp":"'), F.format_string("%d-%d", "conv_id", "turn"), F.lit('","cwd":"/w","message":'), said, F.lit("}"))
    return t.where("role in ('user', 'assistant')").select("conv_id", "turn", line.alias("value"))


@query()
def long_log_turns(spark, sf_dir):
    """Logs of a thousand conversations each, written and read again by byte splits: the messages of each log."""
    from ..scratch import folder
    from ..sources import long_logs

    at = folder(spark, "claude-logs")
    lines = _claude_lines(table(spark, sf_dir, "conversations")).withColumn("log", F.concat(F.lit("-home-ann-p"), F.floor(F.col("conv_id") / 1000)))
    # A log is one file, so one task writes it, in order; there are as many logs as thousands of conversations.
    lines.repartition("log").sortWithinPartitions("log", "conv_id", "turn").select("log", "value").write.option("maxRecordsPerFile", 0).partitionBy("log").text(at)
    sessions, messages = long_logs.read(spark, "claude", at, pattern="*.txt")
    return messages.join(sessions.select("path", "project"), "path").select("project", "n", "role", "timestamp", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query()
def selected_project_messages(spark, sf_dir):
    """Logs of nine projects, of which three are read: their messages by project."""
    from ..scratch import folder
    from ..sources import selected

    at = folder(spark, "project-logs")
    lines = _claude_lines(table(spark, sf_dir, "conversations")).withColumn("log", F.concat(F.lit("-home-ann-p"), F.pmod("conv_id", F.lit(9))))
    lines.repartition("log", F.pmod(F.hash("conv_id", "turn"), F.lit(64))).select("log", "value").write.option("maxRecordsPerFile", 5000).partitionBy("log").text(at)
    found = selected.logs(spark, "claude", at, ["p1", "p4", "p7"], pattern="*.txt")
    count = lambda c: F.sum(f"stats.{c}").alias(c)
    return found.groupBy("project").agg(count("user_messages"), count("assistant_messages"), F.sum(F.size("messages")).alias("messages"))


@query()
def latest_changes_by_runs(spark, sf_dir):
    """The last change of each client, from four batches upserted one after the other into sorted runs."""
    from ..scratch import folder
    from ..streaming.runs import Runs

    rows = table(spark, sf_dir, "client_changes").selectExpr(
        "cast(client_id as string) as key", "cast(seq as int) as n_messages", "cast(change_id as long) as n_bytes", "cast(valid_at as string) as end_time",
        "concat_ws('|', coalesce(op, ''), coalesce(segment, ''), coalesce(city, ''), coalesce(cast(balance as string), '')) as line",
    )
    runs = Runs(spark, folder(spark, "runs"), "key string, n_messages int, n_bytes long, end_time string, line string", fan=3)
    for n in range(4):
        runs.upsert(rows.where(F.pmod("n_bytes", F.lit(4)) == n), n)
        runs.compact()
    return runs.read().select(F.col("key").alias("client_id"), F.col("n_messages").alias("seq"), F.col("n_bytes").alias("change_id"), F.col("end_time").alias("valid_at"), "line")


@query(
    """select doc_id, cast(sum(case when doc_id % 11 = 3 or doc_id % 13 = 5 then 1 else 0 end) as bigint) as removed, cast(sum(case when doc_id % 11 = 3 and doc_id % 13 <> 5 then 1 else 0 end) as bigint) as added
from documents where doc_id % 11 = 3 or doc_id % 13 = 5 group by doc_id"""
)
def dataset_differences(spark, sf_dir):
    """Documents against a copy in which some changed and some are missing, found by hash trees."""
    from ..operators.integrity import differences

    columns = ["doc_id", "text", "lang", "source"]
    old = table(spark, sf_dir, "documents").select(*columns)
    changed = F.when(F.col("doc_id") % 11 == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text"))
    new = old.where("doc_id is null or doc_id % 13 <> 5").withColumn("text", changed)
    return differences(old, new, "doc_id", columns)
