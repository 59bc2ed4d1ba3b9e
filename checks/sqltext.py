"""DuckDB expressions stating the rules independently of the Spark builders."""

from __future__ import annotations

from .views import mail_sql

# The reply and forward prefixes.
PREFIXES = "re|fwd|fw|aw|wg|sv|rv|res|enc|vb|tr|ré|antw|antwort|回复|轉寄|转发|пере|ответ|轉發"


def domain(x: str) -> str:
    s = f"lower(trim({x}))"
    return f"case when strpos({s}, '@') > 0 then trim(substr({s}, strpos({s}, '@') + 1)) else '' end"


def canonical(x: str) -> str:
    """Canonical address or null."""
    s = f"lower(trim({x}))"
    local, dom = f"trim(split_part({s}, '@', 1))", f"trim(substr({s}, strpos({s}, '@') + 1))"
    bare = f"case when {dom} in ('gmail.com', 'googlemail.com') then replace(split_part({local}, '+', 1), '.', '') else {local} end"
    whole = f"({bare} || '@' || {dom})"
    return f"case when regexp_full_match({whole}, '[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}') then {whole} end"


def subject(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    return f"trim(regexp_replace({flat}, '(?i)^\\s*(?:(?:{PREFIXES})\\s*(?:\\[\\d+\\])?\\s*:\\s*)+', ''))"


def ids(x: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({x}, ''), '<([^>]+)>', 1), lambda i: lower(trim(i)))"


# Roles: unnest sender and recipients with a position and take the first fitting one.
ROLES = f"""src as ({mail_sql()}),
boxes as (
    select uid_n, 0 as pos, from_raw as raw from src
    union all select uid_n, 1, to_raw from src
    union all select uid_n, 2, cc_raw from src),
faces as (
    select uid_n, pos, trim(raw) as raw, {domain('raw')} = 'agency.example' as agency, {canonical('raw')} as canon from boxes),
picked as (
    select uid_n,
        max(canon) filter (where pos = 0) as sender,
        bool_or(pos = 0 and raw <> '' and not agency) as outside,
        bool_or(pos = 0 and agency) as inside,
        arg_min(canon, pos) filter (where pos > 0 and raw <> '' and not agency and canon is not null) as other_out,
        arg_min(canon, pos) filter (where pos > 0 and agency and canon is not null) as other_in,
        arg_min(canon, pos) filter (where pos > 0 and canon is not null) as recipient
    from faces group by uid_n),
roles as (
    select uid_n, sender, recipient,
        case when outside then sender else other_out end as customer,
        case when inside then sender else other_in end as agent
    from picked),
keyed as (
    select s.*, r.sender, r.recipient, r.customer, r.agent,
        case when customer is not null and agent is not null
                then sha256('pair:' || least(customer, agent) || '|' || greatest(customer, agent))
             when sender is not null and recipient is not null
                then sha256('pair:' || least(sender, recipient) || '|' || greatest(sender, recipient)) end as conversation_id
    from src s join roles r using (uid_n))"""

# Header ids of mail_src.
LINKS = f"""src as ({mail_sql('uid_n', 'mailbox', 'mailbox_ord', 'sent_ts', 'message_id_raw', 'in_reply_to_raw', 'references_raw')}),
links as (
    select uid_n, mailbox, mailbox_ord, sent_ts, {ids('message_id_raw')}[1] as message_id, {ids('in_reply_to_raw')}[1] as parent,
        {ids('references_raw')}[1] as first_ref
    from src)"""


def walk(top: str, own: str) -> str:
    """Roots and depths by walking up from each message; ``top`` is the root of a walk ending at a known
    message without headers and ``own`` that of a message without headers."""
    return f"""idx as (
    select message_id, parent, first_ref from (
        select *, row_number() over (partition by message_id order by mailbox_ord desc, uid_n desc) as rn from links) where rn = 1),
walk as (
    select uid_n, parent as cur, 1 as hops, [parent] as seen from links where first_ref is null and parent is not null
    union all
    select w.uid_n, i.parent, w.hops + 1, list_append(w.seen, i.parent) from walk w join idx i on i.message_id = w.cur
    where i.first_ref is null and i.parent is not null and not list_contains(w.seen, i.parent)),
ends as (
    select w.uid_n, w.hops, case when i.message_id is null then w.cur when i.first_ref is not null then i.first_ref else {top} end as root
    from walk w left join idx i on i.message_id = w.cur
    where i.message_id is null or i.first_ref is not null or i.parent is null),
rooted as (
    select l.*, case when l.first_ref is not null then l.first_ref when l.parent is null then {own} else e.root end as root_message_id,
        case when l.first_ref is not null or l.parent is null then 0 else e.hops end as hops
    from links l left join ends e using (uid_n))"""
