"""Keyed entity reads: every request is answered, found or not, by one join with the state of its kind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.ledger import micros, table
from .sessions import _stored

#: Answer codes, and the number that a flag is shown as.
CODES = {"account": "INVALID_ACCOUNT_ID", "contract": "INVALID_CONTRACT_ID", "topic": "INVALID_TOPIC_ID", "file": "INVALID_FILE_ID", "schedule": "INVALID_SCHEDULE_ID", "token": "INVALID_TOKEN_ID", "nft": "INVALID_NFT_ID"}
YES, NO = 1, 2


def flag(c: Column) -> Column:
    return F.when(c, YES).otherwise(NO)


def positive(c: Column) -> Column:
    """Null unless over zero."""
    return F.when(c > 0, c)


def hex_of(c: Column) -> Column:
    return F.lower(F.hex(c.cast("binary")))


def lookup(requests: DataFrame, state: DataFrame, on: str | list[str], kind: str) -> DataFrame:
    """Each request with its entity's columns and a code: OK, or the kind's not-found code with nulls.  Null ids fail, and
    so does a column that is named as the code is."""
    if "code" in requests.columns + state.columns:
        raise ValueError("a column is named code")
    keys = [on] if isinstance(on, str) else on
    checked = requests
    for k in keys:
        checked = checked.withColumn(k, F.coalesce(k, F.raise_error(F.lit(f"missing {k}"))))
    return checked.join(state.withColumn("_found", F.lit(True)), on, "left").withColumn("code", F.when(F.col("_found"), "OK").otherwise(CODES[kind])).drop("_found")


def of_kind(state: DataFrame, kind: str, column: str = "kind") -> DataFrame:
    """state, failing where a key holds a value of another kind."""
    wrong = F.raise_error(F.concat(F.lit(f"state inconsistency: expected {kind}, found "), F.coalesce(column, F.lit("nothing"))))
    return state.withColumn(column, F.when(F.col(column) == kind, F.col(column)).otherwise(wrong))


def account_info(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """A contract's account shows the hex of its alias, or 0.0.number if that is empty; others show nothing."""
    shown = F.when(F.col("smart_contract"), F.when(F.length("alias") > 0, hex_of(F.col("alias"))).otherwise(F.format_string("0.0.%d", "account_id"))).otherwise("")
    state = accounts.select("account_id", shown.alias("contract_account_id"), "balance", positive(F.col("expiry")).alias("expiry"), F.lit(0).alias("pending_reward"), "memo")
    return lookup(requests, state, "account_id", "account")


def account_balance(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Balance in the smallest unit; 0 where the account is unknown."""
    return lookup(requests, accounts.select("account_id", "balance"), "account_id", "account").withColumn("balance", F.coalesce("balance", F.lit(0)))


def contract_info(requests: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contracts are accounts: the contract's number is looked up there, and an account that is none is not found."""
    state = accounts.where("smart_contract").select(F.col("account_id").alias("contract_id"), hex_of(F.col("alias")).alias("contract_account_id"), "balance", "memo")
    return lookup(requests, state, "contract_id", "contract")


def walked(heads: DataFrame, relations: DataFrame) -> DataFrame:
    """account, token and hop along each account's linked list: from head (account, head, cap) at most cap hops.  A token
    that has no relation ends its list.

    Each round doubles the length: paths of so many links continue all tokens found, and are then joined with themselves.
    """
    found = [_stored(heads.where("head IS NOT NULL AND cap > 0").select("account", F.col("head").alias("token"), "cap", F.lit(1).alias("hop")), "walked")]
    caps = found[0].where("cap > 1").groupBy("account").agg(F.max("cap").alias("cap"))
    paths = _stored(relations.where("next_token IS NOT NULL").select("account", "token", F.col("next_token").alias("to")).join(caps, "account"), "paths")
    links = 1
    while not paths.isEmpty():
        open_ = reduce(DataFrame.unionByName, found).where(F.col("cap") - F.col("hop") >= links)
        further = _stored(open_.join(paths.drop("cap"), ["account", "token"]).select("account", F.col("to").alias("token"), "cap", (F.col("hop") + links).alias("hop")), "walked")
        if further.isEmpty():
            break
        found.append(further)
        links *= 2
        paths = paths.where(F.col("cap") > links)
        paths = _stored(paths.join(paths.select("account", F.col("token").alias("to"), F.col("to").alias("end")), ["account", "to"]).select("account", "token", F.col("end").alias("to"), "cap"), "paths")
    return reduce(DataFrame.unionByName, found).select("account", "token", "hop")


def held(walk: DataFrame, relations: DataFrame) -> DataFrame:
    """walk with the other columns of its relations (account, token, ...); a link to a missing relation fails."""
    found = walk.join(relations.withColumn("_ok", F.lit(True)), ["account", "token"], "left")
    missing = F.raise_error(F.concat(F.lit("missing relation of account "), F.col("account").cast("string"))).cast("bigint")
    return found.withColumn("token", F.when(F.col("_ok"), F.col("token")).otherwise(missing)).drop("_ok")


def token_walk(heads: DataFrame, relations: DataFrame, *more: str) -> DataFrame:
    """account, token and hop along each account's linked list: from head (account, head, cap) at most cap hops.

    relations: account, token, next_token, kyc_granted, frozen, and more columns to show.  A link to a missing relation fails.
    """
    return held(walked(heads, relations), relations).select("account", "token", "hop", flag(F.col("kyc_granted")).alias("kyc"), flag(F.col("frozen")).alias("freeze"), F.lit(0).alias("decimals"), *more)


def account_details(requests: DataFrame, accounts: DataFrame, relations: DataFrame, heads: DataFrame) -> DataFrame:
    """Balance, expiry and the walked token relations of each account, in order; a relation that is there twice shows its
    token once for each time that the walk meets it."""
    found = held(walked(heads, relations), relations.select("account", "token").distinct())
    tokens = found.groupBy("account").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hop", "token"))), lambda x: x["token"].cast("string")), ",").alias("tokens")).withColumnRenamed("account", "account_id")
    state = accounts.join(tokens, "account_id", "left").select("account_id", "balance", "expiry", F.coalesce("tokens", F.lit("")).alias("tokens"))
    return lookup(requests, state, "account_id", "account")


def granted_allowances(accounts: DataFrame) -> DataFrame:
    """Allowances (array of spender, amount) as granted ones, with the owner."""
    return accounts.select("account_id", F.transform("allowances", lambda a: F.struct(a["spender"].alias("spender_id"), a["amount"].alias("amount_granted"))).alias("granted"))


def version_info(singletons: DataFrame) -> DataFrame:
    """One row: the creation version under both names; nulls, and still OK, where there is none."""
    one = singletons.agg(F.max("version").alias("v"))
    return one.select(F.col("v").alias("protocol_version"), F.col("v").alias("services_version"), F.lit("OK").alias("code"))


def no_records(requests: DataFrame) -> DataFrame:
    """Records are not indexed: every request is answered OK, with none."""
    return requests.select("account_id", F.array().cast("array<string>").alias("records"), F.lit("OK").alias("code"))


def no_receipt(requests: DataFrame) -> DataFrame:
    return requests.select("transaction_id", F.lit("RECEIPT_NOT_FOUND").alias("code"))


def no_transaction_record(requests: DataFrame) -> DataFrame:
    """Echoes the id, which must be there."""
    return requests.select(F.coalesce("transaction_id", F.raise_error(F.lit("missing transaction_id"))).alias("transaction_id"), F.lit("RECORD_NOT_FOUND").alias("code"))


def accounts(s, d) -> DataFrame:
    c = table(s, d, "customer")
    cents = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return c.select(
        F.col("c_custkey").alias("account_id"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_name")).otherwise("").alias("alias"), cents.alias("balance"), cents.alias("expiry"),
        F.col("c_mktsegment").alias("memo"), (F.col("c_custkey") % 3 == 0).alias("smart_contract"),
        F.array(F.struct(F.col("c_nationkey").alias("spender"), cents.alias("amount")), F.struct((F.col("c_nationkey") + 1).alias("spender"), (cents * 2).alias("amount"))).alias("allowances"),
    )


def relations(s, d) -> DataFrame:
    from pyspark.sql import Window

    o = table(s, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return o.select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("token"), F.lead("o_orderkey").over(w).alias("next_token"), (F.col("o_orderstatus") == "O").alias("kyc_granted"), (F.col("o_orderkey") % 4 == 0).alias("frozen"))


def heads(s, d) -> DataFrame:
    return table(s, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.min("o_orderkey").alias("head")).withColumn("cap", F.col("account") % 5)


def _ids(s, d, name: str, key: str, alias: str) -> DataFrame:
    """Every key, and as many that no entity has."""
    k = table(s, d, name).select(F.col(key).cast("bigint").alias(alias))
    return k.unionByName(k.select((F.col(alias) + 1_000_000_000).alias(alias)))


def _topics(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("topic_id")).agg(F.count("*").alias("sequence_number"), F.max(micros("ts")).alias("expiry"))


def _files(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("file_id"), F.octet_length("text").cast("bigint").alias("size"), positive(F.col("n_chars") - 1000).alias("expiry"), F.col("source").alias("memo"), F.md5("text").alias("contents"))


QUERIES = {
    "account_info": lambda s, d: account_info(_ids(s, d, "customer", "c_custkey", "account_id"), accounts(s, d)),
    "account_balance": lambda s, d: account_balance(_ids(s, d, "customer", "c_custkey", "account_id"), accounts(s, d)),
    "contract_info": lambda s, d: contract_info(_ids(s, d, "customer", "c_custkey", "contract_id"), accounts(s, d)),
    "account_details": lambda s, d: account_details(_ids(s, d, "customer", "c_custkey", "account_id"), accounts(s, d), relations(s, d), heads(s, d)),
    "token_relationship_walk": lambda s, d: token_walk(heads(s, d), relations(s, d)),
    "allowance_transform": lambda s, d: granted_allowances(accounts(s, d)).select("account_id", F.explode("granted").alias("g")).select("account_id", "g.spender_id", "g.amount_granted"),
    "topic_info": lambda s, d: lookup(_topics(s, d).select("topic_id").unionByName(s.createDataFrame([("none",)], "topic_id string")), _topics(s, d), "topic_id", "topic"),
    "file_info": lambda s, d: lookup(_ids(s, d, "documents", "doc_id", "file_id"), _files(s, d).drop("contents"), "file_id", "file"),
    "file_content": lambda s, d: lookup(_ids(s, d, "documents", "doc_id", "file_id"), _files(s, d).select("file_id", "contents"), "file_id", "file"),
    "schedule_info": lambda s, d: lookup(_ids(s, d, "orders", "o_orderkey", "schedule_id"), table(s, d, "orders").select(F.col("o_orderkey").alias("schedule_id"), F.col("o_custkey").alias("payer"), F.col("o_orderpriority").alias("memo"), micros("o_orderdate").alias("expiry")), "schedule_id", "schedule"),
    "token_info": lambda s, d: lookup(_ids(s, d, "part", "p_partkey", "token_id"), table(s, d, "part").select(F.col("p_partkey").alias("token_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"), flag(F.col("p_size") % 2 == 0).alias("freeze"), flag(F.col("p_size") % 3 == 0).alias("kyc"), flag(F.col("p_size") % 5 == 0).alias("pause")), "token_id", "token"),
    "nft_info": lambda s, d: lookup(
        table(s, d, "lineitem").select(F.col("l_partkey").alias("token_id"), F.col("l_linenumber").alias("serial")).distinct().unionByName(s.createDataFrame([(-1, 1)], "token_id bigint, serial int")),
        table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("token_id"), F.col("l_linenumber").alias("serial")).agg(F.min("l_suppkey").alias("owner"), F.min(micros("l_shipdate")).alias("created")),
        ["token_id", "serial"], "nft"),
    "contract_bytecode": lambda s, d: lookup(_ids(s, d, "pages", "page_id", "contract_id"), table(s, d, "pages").select(F.col("page_id").alias("contract_id"), F.md5("html").alias("code_digest"), F.octet_length("html").cast("bigint").alias("size")), "contract_id", "contract"),
    "version_info": lambda s, d: version_info(table(s, d, "region").where("r_regionkey = 0").select(F.lit("0.45.1").alias("version"))),
}
_ACC = """a AS (SELECT c_custkey AS account_id, CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE '' END AS alias, round(c_acctbal * 100)::BIGINT AS balance, c_mktsegment AS memo, c_custkey % 3 = 0 AS sc, c_nationkey FROM customer)"""


def _req(name: str, key: str, alias: str) -> str:
    return f"q AS (SELECT {key} AS {alias} FROM {name} UNION ALL SELECT {key} + 1000000000 FROM {name})"


def _code(col: str, kind: str) -> str:
    return f"CASE WHEN {col} IS NOT NULL THEN 'OK' ELSE '{CODES[kind]}' END AS code"


_WALK = """rel AS (SELECT o_custkey AS account, o_orderkey AS token, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nx, o_orderstatus = 'O' AS k, o_orderkey % 4 = 0 AS f FROM orders),
    w AS (SELECT account, min(token) AS token, account % 5 AS cap, 1 AS hop FROM rel GROUP BY account HAVING account % 5 > 0
      UNION ALL SELECT w.account, r.nx, w.cap, w.hop + 1 FROM w JOIN rel r ON r.account = w.account AND r.token = w.token WHERE r.nx IS NOT NULL AND w.hop < w.cap)"""
SQL = {
    "account_info": f"""WITH {_ACC}, {_req("customer", "c_custkey", "account_id")} SELECT q.account_id, CASE WHEN a.account_id IS NULL THEN NULL WHEN sc THEN CASE WHEN alias <> '' THEN lower(hex(encode(alias))) ELSE '0.0.' || a.account_id END ELSE '' END AS contract_account_id,
        balance, CASE WHEN balance > 0 THEN balance END AS expiry, CASE WHEN a.account_id IS NOT NULL THEN 0 END AS pending_reward, memo, {_code("a.account_id", "account")} FROM q LEFT JOIN a USING (account_id)""",
    "account_balance": f"""WITH {_ACC}, {_req("customer", "c_custkey", "account_id")} SELECT account_id, coalesce(balance, 0) AS balance, {_code("balance", "account")} FROM q LEFT JOIN a USING (account_id)""",
    "contract_info": f"""WITH {_ACC}, {_req("customer", "c_custkey", "contract_id")} SELECT contract_id, lower(hex(encode(alias))) AS contract_account_id, balance, memo, {_code("account_id", "contract")} FROM q LEFT JOIN a ON contract_id = account_id AND sc""",
    "account_details": f"""WITH RECURSIVE {_WALK}, {_ACC}, {_req("customer", "c_custkey", "account_id")}, t AS (SELECT account, string_agg(token::VARCHAR, ',' ORDER BY hop) AS tokens FROM w GROUP BY account)
        SELECT q.account_id, balance, balance AS expiry, CASE WHEN a.account_id IS NOT NULL THEN coalesce(tokens, '') END AS tokens, {_code("a.account_id", "account")} FROM q LEFT JOIN a USING (account_id) LEFT JOIN t ON t.account = a.account_id""",
    "token_relationship_walk": f"WITH RECURSIVE {_WALK} SELECT w.account, w.token, w.hop, CASE WHEN k THEN 1 ELSE 2 END AS kyc, CASE WHEN f THEN 1 ELSE 2 END AS freeze, 0 AS decimals FROM w JOIN rel USING (account, token)",
    "allowance_transform": f"WITH {_ACC} SELECT account_id, c_nationkey AS spender_id, balance AS amount_granted FROM a UNION ALL SELECT account_id, c_nationkey + 1, balance * 2 FROM a",
    "topic_info": f"""WITH t AS (SELECT event_type AS topic_id, count(*) AS sequence_number, max(epoch_us(ts)) AS expiry FROM events GROUP BY 1), q AS (SELECT topic_id FROM t UNION ALL SELECT 'none')
        SELECT topic_id, sequence_number, expiry, {_code("sequence_number", "topic")} FROM q LEFT JOIN t USING (topic_id)""",
    "file_info": f"WITH {_req('documents', 'doc_id', 'file_id')} SELECT file_id, octet_length(encode(text))::BIGINT AS size, CASE WHEN n_chars > 1000 THEN n_chars - 1000 END AS expiry, source AS memo, {_code('doc_id', 'file')} FROM q LEFT JOIN documents ON file_id = doc_id",
    "file_content": f"WITH {_req('documents', 'doc_id', 'file_id')} SELECT file_id, md5(text) AS contents, {_code('doc_id', 'file')} FROM q LEFT JOIN documents ON file_id = doc_id",
    "schedule_info": f"WITH {_req('orders', 'o_orderkey', 'schedule_id')} SELECT schedule_id, o_custkey AS payer, o_orderpriority AS memo, epoch_us(o_orderdate) AS expiry, {_code('o_orderkey', 'schedule')} FROM q LEFT JOIN orders ON schedule_id = o_orderkey",
    "token_info": f"""WITH {_req('part', 'p_partkey', 'token_id')} SELECT token_id, p_name AS name, p_brand AS symbol, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS freeze,
        CASE WHEN p_partkey IS NULL THEN NULL WHEN p_size % 3 = 0 THEN 1 ELSE 2 END AS kyc, CASE WHEN p_partkey IS NULL THEN NULL WHEN p_size % 5 = 0 THEN 1 ELSE 2 END AS pause, {_code('p_partkey', 'token')} FROM q LEFT JOIN part ON token_id = p_partkey""",
    "nft_info": f"""WITH n AS (SELECT l_partkey AS token_id, l_linenumber AS serial, min(l_suppkey) AS owner, min(epoch_us(l_shipdate)) AS created FROM lineitem GROUP BY 1, 2), q AS (SELECT token_id, serial FROM n UNION ALL SELECT -1, 1)
        SELECT token_id, serial, owner, created, {_code('owner', 'nft')} FROM q LEFT JOIN n USING (token_id, serial)""",
    "contract_bytecode": f"WITH {_req('pages', 'page_id', 'contract_id')} SELECT contract_id, md5(html) AS code_digest, octet_length(encode(html))::BIGINT AS size, {_code('page_id', 'contract')} FROM q LEFT JOIN pages ON contract_id = page_id",
    "version_info": "SELECT '0.45.1' AS protocol_version, '0.45.1' AS services_version, 'OK' AS code",
}
