"""Addresses, roles, customers and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from maillake.functions import address, clean, conversation, privacy, roles
from maillake.operators import analytics, enrich, people
from maillake.sources import side_inputs

from . import sqltext, views
from .registry import query

SRC = views.mail_sql()
BOXES = f"""src as ({SRC}), boxes as (
    select from_raw as raw from src union all select to_raw from src union all select cc_raw from src)"""


def _boxes(spark, sf_dir):
    src = views.mail_src(spark, sf_dir)
    return src.select(F.explode(F.array("from_raw", "to_raw", "cc_raw")).alias("raw"))


@query(
    "normalize_addresses",
    f"""with {BOXES}, faces as (select {sqltext.canonical('raw')} as canonical, {sqltext.domain('raw')} as domain from boxes)
    select canonical, domain, (canonical is not null) as valid, count(*)::bigint as uses from faces group by all""",
)
def normalize_addresses(spark, sf_dir):
    raw = F.col("raw")
    faces = _boxes(spark, sf_dir).select(
        address.canonical_email(raw).alias("canonical"),
        address.email_domain(raw).alias("domain"),
        address.is_valid_email(raw).alias("valid"),
    )
    return faces.groupBy("canonical", "domain", "valid").agg(F.count(F.lit(1)).alias("uses"))


@query(
    "documents_contact_addresses",
    f"""with tokens as (
        select unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+')) as token from documents),
    faces as (select {sqltext.canonical('token')} as canonical from tokens)
    select canonical, substr(canonical, 1, 1) || '***@' || split_part(canonical, '@', 2) as masked, count(*)::bigint as uses
    from faces where canonical is not null group by all""",
)
def documents_contact_addresses(spark, sf_dir):
    tokens = views.table(spark, sf_dir, "documents").select(F.explode(address.emails_in_text("text")).alias("token"))
    faces = tokens.select(address.canonical_email("token").alias("canonical")).where("canonical is not null")
    counted = faces.groupBy("canonical").agg(F.count(F.lit(1)).alias("uses"))
    return counted.withColumn("masked", privacy.mask_email("canonical"))


@query(
    "mask_addresses",
    f"""with {BOXES}, uses as (select raw, count(*)::bigint as uses from boxes group by raw)
    select raw, uses, case when strpos(raw, '@') = 0 then ''
        when trim(split_part(raw, '@', 1)) = '' then '*@' || substr(raw, strpos(raw, '@') + 1)
        else substr(trim(split_part(raw, '@', 1)), 1, 1) || '***@' || substr(raw, strpos(raw, '@') + 1) end as masked
    from uses""",
)
def mask_addresses(spark, sf_dir):
    uses = _boxes(spark, sf_dir).groupBy("raw").agg(F.count(F.lit(1)).alias("uses"))
    return uses.withColumn("masked", privacy.mask_email("raw"))


@query(
    "mask_logins",
    """with logins as (
        select case c_custkey % 3 when 0 then c_name when 1 then substr(c_name, 1, 1) || '@' || c_mktsegment
            else c_name || '@host' || c_nationkey || '.example' end as login from customer)
    select login, count(*)::bigint as uses, case when strpos(login, '@') = 0 then substr(login, 1, 1) || '***'
        when strpos(login, '@') <= 2 then repeat('*', strpos(login, '@') - 1) || substr(login, strpos(login, '@'))
        else substr(login, 1, 1) || '***' || substr(login, strpos(login, '@')) end as masked
    from logins group by login""",
)
def mask_logins(spark, sf_dir):
    logins = views.table(spark, sf_dir, "customer").selectExpr(
        "case c_custkey % 3 when 0 then c_name when 1 then substr(c_name, 1, 1) || '@' || c_mktsegment "
        "else c_name || '@host' || c_nationkey || '.example' end as login"
    )
    uses = logins.groupBy("login").agg(F.count(F.lit(1)).alias("uses"))
    return uses.withColumn("masked", privacy.mask_login("login"))


_FLAG = "case event_type when 'view' then ' Yes ' when 'click' then 'ON' when 'signup' then 't' when 'error' then 'no' end"


@query(
    "bool_flags",
    f"""with flags as (select event_type, {_FLAG} as flag from events)
    select event_type,
        count(*) filter (where coalesce(lower(trim(flag)) in ('1', 'true', 'yes', 'y', 't', 'on'), true))::bigint as yes_or_missing,
        count(*) filter (where coalesce(lower(trim(flag)) in ('1', 'true', 'yes', 'y', 't', 'on'), false))::bigint as yes,
        count(*) filter (where coalesce(lower(trim(flag)) in ('1', 'true', 'yes', 'y', 'on'), false))::bigint as yes_short_list
    from flags group by event_type""",
)
def bool_flags(spark, sf_dir):
    flags = views.table(spark, sf_dir, "events").selectExpr("event_type", f"{_FLAG} as flag")
    return flags.groupBy("event_type").agg(
        F.count_if(clean.to_bool("flag", True)).alias("yes_or_missing"),
        F.count_if(clean.to_bool("flag", False)).alias("yes"),
        F.count_if(clean.to_bool("flag", False, clean.PROFILE_TRUE_WORDS)).alias("yes_short_list"),
    )


@query(
    "agency_domain_lists",
    """with lists as (
        select s_suppkey, ' Shop' || (s_suppkey % 5) || '.example, ,AGENCY.example,agency.example ,' as domains from supplier)
    select 'agency.example,shop' || (s_suppkey % 5) || '.example' as domains, count(*)::bigint as suppliers from lists group by all""",
)
def agency_domain_lists(spark, sf_dir):
    lists = views.table(spark, sf_dir, "supplier").selectExpr(
        "' Shop' || (s_suppkey % 5) || '.example, ,AGENCY.example,agency.example ,' as domains"
    )
    parsed = lists.select(F.array_join(roles.parse_domains_col("domains"), ",").alias("domains"))
    return parsed.groupBy("domains").agg(F.count(F.lit(1)).alias("suppliers"))


@query(
    "agency_messages",
    f"""with {BOXES.split(', boxes')[0]}, flagged as (
        select mailbox, {sqltext.domain('from_raw')} = 'agency.example' or {sqltext.domain('to_raw')} = 'agency.example'
            or {sqltext.domain('cc_raw')} = 'agency.example' as agency from src)
    select mailbox, agency, count(*)::bigint as messages from flagged group by all""",
)
def agency_messages(spark, sf_dir):
    mail = views.headers(spark, sf_dir)
    flagged = mail.select("mailbox", people.in_agency(views.AGENCY).alias("agency"))
    return flagged.groupBy("mailbox", "agency").agg(F.count(F.lit(1)).alias("messages"))


def _role(column: str):
    def run(spark, sf_dir):
        found = people.with_roles(views.headers(spark, sf_dir), views.AGENCY)
        return found.groupBy(F.col(column).alias("email")).agg(F.count(F.lit(1)).alias("messages"))

    return run


for _name, _column, _sql in (
    ("customer_role", "customer_email_normalized", "customer"),
    ("agent_role", "agent_email", "agent"),
    ("first_recipient", "first_recipient_email", "recipient"),
):
    query(_name, f"with {sqltext.ROLES} select {_sql} as email, count(*)::bigint as messages from roles group by 1")(_role(_column))


@query(
    "role_messages",
    f"""with {sqltext.ROLES} select uid_n, sender, recipient, customer, agent, conversation_id from keyed""",
)
def role_messages(spark, sf_dir):
    found = people.with_roles(views.headers(spark, sf_dir), views.AGENCY)
    return found.select(
        "uid_n",
        F.col("from_email_normalized").alias("sender"),
        F.col("first_recipient_email").alias("recipient"),
        F.col("customer_email_normalized").alias("customer"),
        F.col("agent_email").alias("agent"),
        "conversation_id",
    )


@query(
    "pair_conversations",
    f"""with {sqltext.ROLES}
    select conversation_id, count(*)::bigint as messages, min(sent_ts) as first_sent, max(sent_ts) as last_sent,
        count(distinct customer)::bigint as customers,
        arg_max({sqltext.subject('subject_raw')}, (sent_ts, mailbox_ord, uid_n)) as last_subject
    from keyed where conversation_id is not null group by conversation_id""",
)
def pair_conversations(spark, sf_dir):
    found = people.with_roles(views.headers(spark, sf_dir), views.AGENCY)
    return analytics.conversations(found)


def _enriched(spark, sf_dir, **options):
    found = people.with_roles(views.headers(spark, sf_dir), views.AGENCY)
    return enrich.with_customer_id(found, views.crm(spark, sf_dir), "acme", **options)


ENRICHED = f"""{sqltext.ROLES}, crm as ({views.CRM_SQL}),
enriched as (
    select k.*, coalesce(c.customer_id, k.customer) as customer_id,
        case when coalesce(c.customer_id, k.customer) <> '' then sha256('customer|acme|' || coalesce(c.customer_id, k.customer)) end as session_id
    from keyed k left join crm c on c.email = k.customer)"""


@query(
    "crm_enrichment",
    f"""with {ENRICHED} select customer as email, customer_id, count(*)::bigint as messages from enriched group by 1, 2""",
)
def crm_enrichment(spark, sf_dir):
    found = _enriched(spark, sf_dir)
    return found.groupBy(F.col("customer_email_normalized").alias("email"), "customer_id").agg(
        F.count(F.lit(1)).alias("messages")
    )


@query(
    "crm_enrichment_salted",
    f"""with {ENRICHED} select customer as email, customer_id, count(*)::bigint as messages from enriched group by 1, 2""",
)
def crm_enrichment_salted(spark, sf_dir):
    """The same result by the salted join that a CRM map too large to broadcast takes."""
    found = _enriched(spark, sf_dir, broadcast_bytes=0)
    return found.groupBy(F.col("customer_email_normalized").alias("email"), "customer_id").agg(
        F.count(F.lit(1)).alias("messages")
    )


@query(
    "crm_map_source",
    """select 'cust' || c_custkey || '@shop' || (c_custkey % 20) || '.example' as email, 'CRM-' || c_custkey as customer_id
    from customer where c_custkey % 3 <> 0""",
)
def crm_map_source(spark, sf_dir):
    """JSON objects with a repeated key, other value types and (every third) a broken text."""
    key = "'\"cust' || c_custkey || '@shop' || (c_custkey % 20) || '.example\"'"
    texts = views.table(spark, sf_dir, "customer").selectExpr(
        f"'{{' || {key} || ': \"old\", \"n' || c_custkey || '\": 1, \"x\": null, \"y\": [\"z\"], ' || {key} || ': \"CRM-' || c_custkey "
        "|| '\"' || case when c_custkey % 3 = 0 then '' else '}' end as value"
    )
    return side_inputs.crm_from_json(texts)


@query(
    "session_ids",
    f"""with {ENRICHED} select uid_n, session_id from enriched""",
)
def session_ids(spark, sf_dir):
    return _enriched(spark, sf_dir).select("uid_n", "session_id")


@query(
    "session_summary",
    f"""with {ENRICHED}
    select session_id, count(*)::bigint as messages, min(sent_ts) as first_sent, max(sent_ts) as last_sent,
        count(distinct conversation_id)::bigint as conversations, count(distinct agent)::bigint as agents
    from enriched where session_id is not null group by session_id""",
)
def session_summary(spark, sf_dir):
    return analytics.sessions(_enriched(spark, sf_dir))


@query(
    "customer_timeline",
    f"""with {ENRICHED}
    select customer_id, count(*)::bigint as messages, min(sent_ts) as first_sent, max(sent_ts) as last_sent,
        count(distinct customer)::bigint as addresses, count(distinct conversation_id)::bigint as conversations
    from enriched where customer_id is not null group by customer_id""",
)
def customer_timeline(spark, sf_dir):
    return analytics.customers(_enriched(spark, sf_dir))


PARTICIPANTS = "list_sort(list_distinct(list_filter([lower(trim(from_raw)), lower(trim(to_raw)), lower(trim(cc_raw))], lambda e: e <> '')))"


@query(
    "participants",
    f"""with src as ({views.mail_sql('uid_n', 'from_raw', 'to_raw', 'cc_raw')})
    select uid_n, array_to_string({PARTICIPANTS}, '|') as participants from src""",
)
def participants(spark, sf_dir):
    found = people.with_participants(views.headers(spark, sf_dir))
    return found.select("uid_n", F.array_join("participants", "|").alias("participants"))


@query(
    "conversation_participants",
    f"""with {sqltext.ROLES}
    select conversation_id, participant, count(*)::bigint as messages
    from (select conversation_id, unnest({PARTICIPANTS}) as participant from keyed where conversation_id is not null)
    group by all""",
)
def conversation_participants(spark, sf_dir):
    found = people.with_roles(views.headers(spark, sf_dir), views.AGENCY)
    return analytics.conversation_participants(people.with_participants(found))


@query(
    "fallback_conversations",
    f"""with src as ({SRC}), keys as (
        select {PARTICIPANTS} as people, strftime(sent_ts, '%Y-%m-%d') as day, lower({sqltext.subject('subject_raw')}) as subject from src)
    select sha256('fallback:{{"date_bucket": "' || day || '", "participants": ['
        || array_to_string(list_transform(people, lambda p: '"' || p || '"'), ', ')
        || '], "subject": "' || subject || '"}}') as fallback_conversation_id, count(*)::bigint as messages
    from keys group by 1""",
)
def fallback_conversations(spark, sf_dir):
    found = people.with_fallback_id(views.headers(spark, sf_dir))
    return found.groupBy("fallback_conversation_id").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "document_json_keys",
    """select doc_id, sha256('"' || replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'),
        chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r'), chr(12), '\\f') || '"') as key_hash, length(text)::bigint as chars from documents""",
)
def document_json_keys(spark, sf_dir):
    """JSON quoting of whole texts, as used for hashed keys."""
    from maillake.functions.jsontext import quoted

    docs = views.table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", F.sha2(quoted("text"), 256).alias("key_hash"), F.length("text").cast("long").alias("chars"))
