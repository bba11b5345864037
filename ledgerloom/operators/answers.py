"""Whole answers of the entity reads: every field, guarded kinds, and the not-found case.

A reader takes requests and a table of state values, each with its ``kind``; a key whose value is of another kind fails.
Answers are made of the state before the one join with the requests, so that what is not found has nulls throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import table
from .entities import CODES, flag, hex_of, lookup, of_kind, positive, token_walk

#: The service that answers each type of query.
SERVICES = {
    "crypto": ["account_info", "account_balance", "account_records", "transaction_receipts", "transaction_record"], "consensus": ["topic_info"], "file": ["file_info", "file_content"],
    "schedule": ["schedule_info"], "token": ["token_info", "nft_info"], "contract": ["contract_info", "contract_bytecode"], "network": ["version_info", "account_details"],
}


def dispatch(requests: DataFrame) -> DataFrame:
    """requests (service, query: its type) with a code: OK, or INVALID_ARGUMENT for a type, or none, that its service does not answer."""
    known = F.lit(False)
    for service, queries in SERVICES.items():
        known = known | ((F.col("service") == service) & F.col("query").isin(queries))
    return requests.withColumn("code", F.when(known, "OK").otherwise("INVALID_ARGUMENT"))


def only(requests: DataFrame, query: str) -> DataFrame:
    """requests, failing where one is of another type than query."""
    wrong = F.raise_error(F.concat(F.lit(f"INVALID_ARGUMENT: expected {query}, found "), F.coalesce("query", F.lit("nothing"))))
    return requests.where(F.when(F.col("query") == query, True).otherwise(wrong.cast("boolean"))).drop("query")


def typed(answer):
    """A reader of one kind of state values."""

    def reader(requests: DataFrame, state: DataFrame, on: str | list[str], kind: str, query: str | None = None) -> DataFrame:
        keys = [on] if isinstance(on, str) else on
        held = of_kind(state, kind).where(F.col("kind").isNotNull())
        asked = only(requests, query) if query else requests
        return lookup(asked, held.select(*keys, *(c.alias(n) for n, c in answer().items())), on, kind if kind in CODES else "contract")

    return reader


def same(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


@typed
def account_info() -> dict[str, Column]:
    number = F.format_string("0.0.%d", "account_id")
    contract = F.when(F.col("smart_contract"), F.when(F.length("alias") > 0, hex_of(F.col("alias"))).otherwise(number)).otherwise("")
    return {
        "contract_account_id": contract, "balance": F.col("tinybar_balance"), "auto_renew_period": positive(F.col("auto_renew_seconds")), "expiration_time": positive(F.col("expiration_second")),
        "stake_period_start": positive(F.col("stake_period_start")), "pending_reward": F.lit(0), "owned_nfts": F.col("number_owned_nfts"), "max_automatic_token_associations": F.col("max_auto_associations"),
        **same("memo", "key", "receiver_sig_required", "deleted", "staked_to_me", "decline_reward", "staked_node_id", "staked_account_id", "ethereum_nonce", "alias"),
    }


@typed
def account_details() -> dict[str, Column]:
    """state carries token_relationships, as ``relationships`` gives them, and the three lists of allowances."""
    granted = lambda c, *names: F.transform(c, lambda a: F.struct(*(a[n].alias(m) for n, m in names)))
    return {
        "contract_account_id": F.when(F.col("smart_contract"), hex_of(F.col("alias"))).otherwise(""), "proxy_received": F.col("staked_to_me"), "balance": F.col("tinybar_balance"),
        "expiration_time": F.col("expiration_second"), "auto_renew_period": F.col("auto_renew_seconds"), "owned_nfts": F.col("number_owned_nfts"), "max_automatic_token_associations": F.col("max_auto_associations"),
        "token_relationships": F.coalesce("token_relationships", F.array().cast(_RELATIONS)), "granted_crypto_allowances": granted("crypto_allowances", ("spender", "spender"), ("amount", "amount")),
        "granted_nft_allowances": granted("nft_allowances", ("token", "token_id"), ("spender", "spender")),
        "granted_token_allowances": granted("token_allowances", ("token", "token_id"), ("spender", "spender"), ("amount", "amount")),
        **same("deleted", "key", "receiver_sig_required", "memo", "alias"),
    }


_RELATIONS = "array<struct<token_id:bigint,balance:bigint,kyc_status:int,freeze_status:int,decimals:int,automatic_association:boolean>>"


def relationships(heads: DataFrame, relations: DataFrame) -> DataFrame:
    """account and its token_relationships in the order of its list (see token_walk); relations also have balance and automatic."""
    walked = token_walk(heads, relations, "balance", "automatic")
    one = F.struct("hop", F.col("token").alias("token_id"), "balance", F.col("kyc").alias("kyc_status"), F.col("freeze").alias("freeze_status"), F.col("decimals"), F.col("automatic").alias("automatic_association"))
    told = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*(x[n].alias(n) for n in ("token_id", "balance", "kyc_status", "freeze_status", "decimals", "automatic_association"))))
    return walked.groupBy("account").agg(told.cast(_RELATIONS).alias("token_relationships"))


@typed
def topic_info() -> dict[str, Column]:
    return {"expiration_time": F.col("expiration_second"), "auto_renew_account": F.col("auto_renew_account_id"), **same("memo", "running_hash", "sequence_number", "admin_key", "submit_key", "auto_renew_period", "fee_schedule_key", "fee_exempt_key_list", "custom_fees")}


@typed
def file_info() -> dict[str, Column]:
    return {"size": F.octet_length("contents").cast("bigint"), "expiration_time": positive(F.col("expiration_second")), **same("deleted", "keys", "memo")}


@typed
def file_content() -> dict[str, Column]:
    return same("contents")


@typed
def schedule_info() -> dict[str, Column]:
    return {"scheduled_transaction_body": F.col("scheduled_transaction"), "signers": F.col("signatories"), "creator_account_id": F.col("scheduler_account_id"), **same("memo", "admin_key", "payer_account_id", "wait_for_expiry")}


@typed
def token_info() -> dict[str, Column]:
    flags = {"default_freeze_status": "accounts_frozen_by_default", "default_kyc_status": "accounts_kyc_granted_by_default", "pause_status": "paused"}
    renamed = {"treasury": "treasury_account_id", "auto_renew_account": "auto_renew_account_id", "auto_renew_period": "auto_renew_seconds", "expiry": "expiration_second"}
    names = "name symbol decimals total_supply admin_key kyc_key freeze_key wipe_key supply_key deleted memo token_type supply_type max_supply fee_schedule_key custom_fees pause_key metadata metadata_key".split()
    return {**{n: flag(F.col(c)) for n, c in flags.items()}, **{n: F.col(c) for n, c in renamed.items()}, **same(*names)}


@typed
def nft_info() -> dict[str, Column]:
    return {"account_id": F.col("owner_id"), "creation_time": F.col("mint_time"), **same("metadata", "spender_id")}


@typed
def contract_bytecode() -> dict[str, Column]:
    return {"bytecode": F.col("code")}


def version_info(singletons: DataFrame) -> DataFrame:
    """One row: the creation version of the block stream's singleton under both names; nulls, and still OK, where there is none."""
    v = singletons.agg(F.max("creation_software_version").alias("v"))
    return v.select(F.col("v").alias("protocol_version"), F.col("v").alias("services_version"), F.lit("OK").alias("code"))


#: State over the driver's tables, in SQL that Spark and DuckDB both read.
_STATE = {
    "account": """SELECT c_custkey AS account_id, 'account' AS kind, CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE '' END AS alias, c_custkey % 3 = 0 AS smart_contract, c_mktsegment AS memo, md5(c_name) AS key,
        CAST(round(c_acctbal * 100) AS BIGINT) AS tinybar_balance, c_custkey % 5 = 0 AS receiver_sig_required, c_custkey % 7 = 0 AS deleted, CAST(c_nationkey AS BIGINT) * 1000 AS auto_renew_seconds,
        CAST(c_nationkey AS BIGINT) - 5 AS expiration_second, c_custkey * 10 AS staked_to_me, CAST(c_nationkey AS BIGINT) - 12 AS stake_period_start, c_custkey % 4 = 1 AS decline_reward,
        CASE WHEN c_custkey % 3 = 1 THEN c_nationkey END AS staked_node_id, CASE WHEN c_custkey % 3 = 2 THEN c_custkey + 1 END AS staked_account_id, c_custkey % 11 AS ethereum_nonce,
        c_custkey % 13 AS number_owned_nfts, c_nationkey AS max_auto_associations, c_nationkey AS nation FROM {customer}""",
    "topic": """SELECT event_type AS topic_id, 'topic' AS kind, event_type || ' memo' AS memo, md5(event_type) AS running_hash, count(*) AS sequence_number, max(event_id) AS expiration_second, md5('a' || event_type) AS admin_key,
        md5('s' || event_type) AS submit_key, min(event_id) AS auto_renew_period, min(user_id) AS auto_renew_account_id, md5('f' || event_type) AS fee_schedule_key, md5('e' || event_type) AS fee_exempt_key_list, count(DISTINCT user_id) AS custom_fees FROM {events} GROUP BY event_type""",
    "file": "SELECT doc_id AS file_id, 'file' AS kind, text AS contents, n_chars - 1000 AS expiration_second, doc_id % 9 = 0 AS deleted, md5(source) AS keys, source AS memo FROM {documents}",
    "schedule": """SELECT o_orderkey AS schedule_id, 'schedule' AS kind, o_orderpriority AS memo, md5(o_orderpriority) AS admin_key, o_custkey AS payer_account_id, o_orderstatus AS scheduled_transaction,
        md5(o_orderstatus) || ',' || md5(o_orderpriority) AS signatories, o_custkey + 1 AS scheduler_account_id, o_orderkey % 2 = 0 AS wait_for_expiry FROM {orders}""",
    "token": """SELECT p_partkey AS token_id, 'token' AS kind, p_name AS name, p_brand AS symbol, p_size % 9 AS decimals, p_partkey * 1000 AS total_supply, p_partkey % 100 AS treasury_account_id, md5('a' || p_name) AS admin_key, md5('k' || p_name) AS kyc_key,
        md5('f' || p_name) AS freeze_key, md5('w' || p_name) AS wipe_key, md5('s' || p_name) AS supply_key, p_size % 2 = 0 AS accounts_frozen_by_default, p_size % 3 = 0 AS accounts_kyc_granted_by_default, p_partkey % 8 = 0 AS deleted,
        p_partkey % 7 AS auto_renew_account_id, p_size * 60 AS auto_renew_seconds, p_size - 3 AS expiration_second, p_type AS memo, p_size % 2 AS token_type, p_size % 3 AS supply_type, p_partkey * 2000 AS max_supply, md5('c' || p_name) AS fee_schedule_key,
        p_brand || ' fee' AS custom_fees, md5('p' || p_name) AS pause_key, p_size % 5 = 0 AS paused, p_type || p_brand AS metadata, md5('m' || p_name) AS metadata_key FROM {part}""",
    "nft": "SELECT l_partkey AS token_id, l_linenumber AS serial, 'nft' AS kind, min(l_suppkey) AS owner_id, min(l_orderkey) AS mint_time, md5(CAST(min(l_orderkey) AS STRING)) AS metadata, max(l_suppkey) AS spender_id FROM {lineitem} GROUP BY l_partkey, l_linenumber",
    "bytecode": "SELECT page_id AS contract_id, 'bytecode' AS kind, html AS code FROM {pages}",
    "version": "SELECT '0.' || CAST(count(*) AS STRING) || '.1' AS creation_software_version FROM {region}",
}
_TABLES = {"account": "customer", "topic": "events", "file": "documents", "schedule": "orders", "token": "part", "nft": "lineitem", "bytecode": "pages", "version": "region"}


def _state(s, d, kind: str) -> DataFrame:
    return s.sql(_STATE[kind], **{_TABLES[kind]: table(s, d, _TABLES[kind])})


def _asked(state: DataFrame, key: str) -> DataFrame:
    """Every key, and as many that no entity has."""
    k = state.select(key)
    return k.unionByName(k.select((F.concat(key, F.lit("?")) if dict(k.dtypes)[key] == "string" else F.col(key) + 1_000_000_000).alias(key)))


def _query(reader, kind: str, *keys: str):
    def run(s, d):
        state = _state(s, d, kind)
        asked = _asked(state, keys[0]) if len(keys) == 1 else state.select(*keys).unionByName(state.select(F.col(keys[0]) + 1_000_000_000, *keys[1:]).toDF(*keys))
        return reader(asked, state, list(keys), kind)

    return run


def _details(s, d) -> DataFrame:
    o = table(s, d, "orders")
    relations = s.sql(
        """SELECT o_custkey AS account, o_orderkey AS token, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next_token, o_orderstatus = 'O' AS kyc_granted,
           o_orderkey % 4 = 0 AS frozen, o_orderkey * 3 AS balance, o_orderkey % 5 = 0 AS automatic FROM {orders}""", orders=o)  # fmt: skip
    heads = o.groupBy(F.col("o_custkey").alias("account")).agg(F.min("o_orderkey").alias("head")).withColumn("cap", F.col("account") % 5)
    allowance = lambda *names: F.array(F.struct(*({"token": F.col("account_id") + 1, "spender": F.col("nation").cast("bigint"), "amount": F.col("tinybar_balance")}[n].alias(n) for n in names)))
    state = _state(s, d, "account").withColumns({"crypto_allowances": allowance("spender", "amount"), "nft_allowances": allowance("token", "spender"), "token_allowances": allowance("token", "spender", "amount")})
    state = state.join(relationships(heads, relations).withColumnRenamed("account", "account_id"), "account_id", "left")
    got = account_details(_asked(state, "account_id"), state, "account_id", "account")
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *(x[n].cast("string") for n in names))), ",").alias(c)
    lists = {"token_relationships": "token_id balance kyc_status freeze_status decimals automatic_association", "granted_crypto_allowances": "spender amount", "granted_nft_allowances": "token_id spender", "granted_token_allowances": "token_id spender amount"}
    return got.select(*(text(c, *lists[c].split()) if c in lists else c for c in got.columns))


def _mixed(s, d) -> DataFrame:
    """Requests of every service for every type, and for none."""
    types = [q for x in SERVICES.values() for q in x] + [None, "transfer"]
    pairs = s.createDataFrame([(k, q) for k in SERVICES for q in types], "service string, query string")
    return table(s, d, "region").crossJoin(F.broadcast(pairs)).select("r_regionkey", "service", "query")


QUERIES = {
    "account_info_whole": _query(account_info, "account", "account_id"), "topic_info_whole": _query(topic_info, "topic", "topic_id"), "file_info_whole": _query(file_info, "file", "file_id"),
    "file_content_whole": _query(file_content, "file", "file_id"), "schedule_info_whole": _query(schedule_info, "schedule", "schedule_id"), "token_info_whole": _query(token_info, "token", "token_id"),
    "nft_info_whole": _query(nft_info, "nft", "token_id", "serial"), "contract_bytecode_whole": _query(contract_bytecode, "bytecode", "contract_id"), "account_details_whole": _details,
    "version_info_whole": lambda s, d: version_info(_state(s, d, "version")), "query_dispatch": lambda s, d: dispatch(_mixed(s, d)),
}


def _sql(kind: str, keys: str, answers: str, code: str, more: str = "") -> str:
    state, key = _STATE[kind].format(**{t: t for t in _TABLES.values()}), keys.split(", ")[0]
    other = f"{key} || '?'" if kind == "topic" else f"{key} + 1000000000"
    rest = "".join(f", {k}" for k in keys.split(", ")[1:])
    return f"""WITH RECURSIVE st AS ({state}){more}, an AS (SELECT {keys}, 1 AS there, {answers} FROM st), q AS (SELECT {keys} FROM st UNION ALL SELECT {other}{rest} FROM st)
        SELECT * EXCLUDE (there), CASE WHEN there = 1 THEN 'OK' ELSE '{code}' END AS code FROM q LEFT JOIN an USING ({keys})"""


_WALKED = """, rel AS (SELECT o_custkey AS account, o_orderkey AS token, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx, o_orderstatus = 'O' AS k, o_orderkey % 4 = 0 AS f, o_orderkey % 5 = 0 AS au FROM orders),
    w AS (SELECT account, min(token) AS token, account % 5 AS cap, 1 AS hop FROM rel GROUP BY account HAVING account % 5 > 0
      UNION ALL SELECT w.account, r.nx, w.cap, w.hop + 1 FROM w JOIN rel r ON r.account = w.account AND r.token = w.token WHERE r.nx IS NOT NULL AND w.hop < w.cap),
    tr AS (SELECT account, string_agg(token || ':' || token * 3 || ':' || CASE WHEN k THEN 1 ELSE 2 END || ':' || CASE WHEN f THEN 1 ELSE 2 END || ':0:' || au, ',' ORDER BY hop) AS told FROM w JOIN rel USING (account, token) GROUP BY account)"""
_NATION = "nation || ':' || tinybar_balance"
SQL = {
    "account_info_whole": _sql("account", "account_id", """CASE WHEN smart_contract THEN CASE WHEN alias <> '' THEN lower(hex(encode(alias))) ELSE '0.0.' || account_id END ELSE '' END AS contract_account_id, tinybar_balance AS balance,
        CASE WHEN auto_renew_seconds > 0 THEN auto_renew_seconds END AS auto_renew_period, CASE WHEN expiration_second > 0 THEN expiration_second END AS expiration_time, CASE WHEN stake_period_start > 0 THEN stake_period_start END AS stake_period_start,
        0 AS pending_reward, number_owned_nfts AS owned_nfts, max_auto_associations AS max_automatic_token_associations, memo, key, receiver_sig_required, deleted, staked_to_me, decline_reward, staked_node_id, staked_account_id, ethereum_nonce, alias""", CODES["account"]),
    "account_details_whole": _sql("account", "account_id", f"""CASE WHEN smart_contract THEN lower(hex(encode(alias))) ELSE '' END AS contract_account_id, staked_to_me AS proxy_received, tinybar_balance AS balance, expiration_second AS expiration_time,
        auto_renew_seconds AS auto_renew_period, number_owned_nfts AS owned_nfts, max_auto_associations AS max_automatic_token_associations, coalesce((SELECT told FROM tr WHERE account = account_id), '') AS token_relationships,
        {_NATION} AS granted_crypto_allowances, (account_id + 1) || ':' || nation AS granted_nft_allowances, (account_id + 1) || ':' || {_NATION} AS granted_token_allowances, deleted, key, receiver_sig_required, memo, alias""", CODES["account"], _WALKED),
    "topic_info_whole": _sql("topic", "topic_id", "expiration_second AS expiration_time, auto_renew_account_id AS auto_renew_account, memo, running_hash, sequence_number, admin_key, submit_key, auto_renew_period, fee_schedule_key, fee_exempt_key_list, custom_fees", CODES["topic"]),
    "file_info_whole": _sql("file", "file_id", "octet_length(encode(contents))::BIGINT AS size, CASE WHEN expiration_second > 0 THEN expiration_second END AS expiration_time, deleted, keys, memo", CODES["file"]),
    "file_content_whole": _sql("file", "file_id", "contents", CODES["file"]),
    "schedule_info_whole": _sql("schedule", "schedule_id", "scheduled_transaction AS scheduled_transaction_body, signatories AS signers, scheduler_account_id AS creator_account_id, memo, admin_key, payer_account_id, wait_for_expiry", CODES["schedule"]),
    "token_info_whole": _sql("token", "token_id", """CASE WHEN accounts_frozen_by_default THEN 1 ELSE 2 END AS default_freeze_status, CASE WHEN accounts_kyc_granted_by_default THEN 1 ELSE 2 END AS default_kyc_status, CASE WHEN paused THEN 1 ELSE 2 END AS pause_status,
        treasury_account_id AS treasury, auto_renew_account_id AS auto_renew_account, auto_renew_seconds AS auto_renew_period, expiration_second AS expiry, name, symbol, decimals, total_supply, admin_key, kyc_key, freeze_key, wipe_key, supply_key, deleted, memo,
        token_type, supply_type, max_supply, fee_schedule_key, custom_fees, pause_key, metadata, metadata_key""", CODES["token"]),
    "nft_info_whole": _sql("nft", "token_id, serial", "owner_id AS account_id, mint_time AS creation_time, metadata, spender_id", CODES["nft"]),
    "contract_bytecode_whole": _sql("bytecode", "contract_id", "code AS bytecode", CODES["contract"]),
    "version_info_whole": "SELECT '0.' || count(*) || '.1' AS protocol_version, '0.' || count(*) || '.1' AS services_version, 'OK' AS code FROM region",
    "query_dispatch": "WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{q}')" for k, x in SERVICES.items() for q in x) + """) AS t(service, query)), q AS (SELECT query FROM s UNION ALL VALUES (NULL), ('transfer')), k AS (SELECT DISTINCT service FROM s)
        SELECT r_regionkey, k.service, q.query, CASE WHEN (k.service, q.query) IN (SELECT (service, query) FROM s) AND q.query IS NOT NULL THEN 'OK' ELSE 'INVALID_ARGUMENT' END AS code FROM region, k, q""",
}
