"""Domain tables derived from the driver's parquet.

Each recipe is SQL that Spark and DuckDB both run, so the same text feeds the
Spark operators and the oracle.  Recipes are chained as CTEs: no temp view is
registered and column pruning reaches the parquet scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

RECIPES: dict[str, str] = {
    "fx_service": """
select * from (values (1,'reddit'),(2,'twitch'),(3,'email'),(4,'twitter')) as t(service_id,service_name)""",
    "fx_user": """
select c_custkey+1 as user_id,
 cast(DATE '1995-01-01' + cast(c_custkey % 2400 as int) as timestamp) as joindate
from customer where c_custkey % 5 <> 4""",
    "fx_username": """
select c_custkey+1 as username_id, c_custkey+1 as user_id,
 case cast(c_custkey % 3 as int) when 0 then 1 when 1 then 2 else 4 end as service_id,
 replace(lower(c_name),'#','_') as username from customer where c_custkey % 5 <> 4
union all
select 1000000000000+c_custkey, c_custkey+1,
 case cast(c_custkey % 3 as int) when 0 then 2 when 1 then 4 else 1 end,
 replace(lower(c_name),'#','_') from customer where c_custkey % 5 <> 4 and c_custkey % 10 = 0
union all
select 2000000000000+service_id, 9000000000000+service_id, service_id, 'tipbot'
from fx_service where service_id <> 3""",
    "fx_address": """
select c_custkey+1 as address_id, c_custkey+1 as user_id, cast(null as bigint) as user_id_alias, 'dog' as coin,
 case when c_custkey % 25 = 0 then null else concat('D', translate(md5(c_name),'0','z')) end as address,
 cast(cast(case when c_acctbal>0 then c_acctbal else 0 end as decimal(20,2)) as decimal(20,8)) as balance
from customer where c_custkey % 5 <> 4""",
    "fx_action": """
select o_orderkey+1 as action_id,
 case cast(o_custkey % 3 as int) when 0 then 1 when 1 then 2 else 4 end as service_id,
 case when o_orderkey % 10 <= 5 then 'givetip' when o_orderkey % 10 = 6 then 'withdraw'
  when o_orderkey % 10 = 7 then 'deposit' when o_orderkey % 10 = 8 then 'gold' else 'history' end as type,
 case when o_orderstatus='F' then 'completed' when o_orderstatus='O' then 'pending'
  when o_orderkey % 3 = 0 then 'failed' when o_orderkey % 3 = 1 then 'declined' else 'expired' end as state,
 o_orderdate + INTERVAL '1' SECOND * cast(o_orderkey % 86400 as int) as ts,
 concat('customer_', lpad(cast(o_custkey as string),9,'0')) as from_user,
 case when o_orderkey % 10 < 5 or o_orderkey % 10 = 8 then concat('customer_',
  lpad(cast((o_custkey*7+o_orderkey) % (select count(*) from customer) as string),9,'0')) end as to_user,
 case when o_orderkey % 10 in (5,6) then concat('D', translate(md5(cast(o_orderkey as string)),'0','z')) end as to_addr,
 cast(cast(o_totalprice as decimal(20,2)) as decimal(20,8)) as coin_val,
 cast(cast(o_totalprice as decimal(20,2)) * cast(0.0002 as decimal(5,4)) as decimal(20,10)) as fiat_val,
 case when o_orderkey % 10 in (6,7) then md5(cast(o_orderkey as string)) end as txid,
 'dog' as coin, 'usd' as fiat,
 case cast(o_custkey % 3 as int) when 1 then concat('#chan', cast(o_custkey % 20 as string))
  when 0 then concat('m', cast(o_orderkey as string)) else concat('tw', cast(o_orderkey as string)) end as config1,
 case when o_custkey % 3 = 0 then concat('sub', cast(o_orderkey % 50 as string)) end as config3
from orders""",
    "fx_message": """
select concat(case when event_id % 2 = 0 then 't4_' else 't1_' end, cast(event_id as string)) as fullname,
 concat('customer_', lpad(cast(user_id as string),9,'0')) as author,
 concat('t1_', cast((event_id*7) % (select count(*) from events) as string)) as parent_id,
 ts as created_utc, concat('sub', cast(event_id % 50 as string)) as subreddit,
 case event_type
  when 'purchase' then concat('nice one +tipbot @customer_', lpad(cast((user_id*3+event_id) % 150 as string),9,'0'),
   ' ', cast(cast(value as decimal(12,2)) as string), ' DOGE verify')
  when 'click' then concat('+/u/tipbot ', cast(cast(value as decimal(12,2)) as string), ' doge')
  when 'signup' then case cast(event_id % 5 as int) when 0 then '+register' when 1 then '+accept' when 2 then '+decline'
    when 3 then '+tipbot gold verify'
    else concat('+withdraw D', translate(md5(cast(event_id as string)),'0','z'), ' 5 doge') end
  when 'view' then case when event_id % 2 = 0 then '+history' else '+tipbot megaflip doge' end
  else case when event_id % 2 = 0 then 'so error' else '+tipbot 100' end end as body
from events""",
    "fx_ticker": """
select event_id as snap_id, ts as fiat_date,
 case cast(user_id % 3 as int) when 0 then 'ex_a' when 1 then 'ex_b' else 'ex_c' end as exchange,
 case when event_type in ('click','view','purchase') then 'dog' else 'btc' end as thing_from,
 case when event_type in ('click','view','purchase') then 'btc' else 'usd' end as thing_to,
 concat('{"return":{"markets":', props, '}}') as payload
from events""",
    "fx_chain_tx": """
select md5(cast(l_orderkey as string)) as txid, l_orderkey, l_linenumber as n,
 case l_returnflag when 'A' then 'send' when 'R' then 'receive' else 'generate' end as category,
 cast(l_orderkey % 12 as int) as confirmations,
 concat('D', translate(md5(concat('Customer#',
  lpad(cast(l_partkey % (select count(*) from customer) as string),9,'0'))),'0','z')) as address,
 cast(cast(l_extendedprice as decimal(20,2)) as decimal(20,8)) as amount
from lineitem""",
    "fx_transfer": """
select o_orderkey+1 as action_id, o_orderdate + INTERVAL '1' SECOND * cast(o_orderkey % 86400 as int) as ts,
 o_custkey+1 as from_id,
 (o_custkey + 1 + (o_orderkey*7) % ((select count(*) from customer)-1)) % (select count(*) from customer) + 1 as to_id,
 cast(4 + (o_orderkey*37) % 3000 as decimal(20,8)) as amount
from orders""",
    "fx_opening": """
select c_custkey+1 as user_id,
 cast(cast(case when c_acctbal>0 then c_acctbal else 0 end as decimal(20,2)) as decimal(20,8)) as balance
from customer""",
    "fx_unprocessed": """
select md5(cast(o_orderkey as string)) as txid, o_orderdate as created_time from orders where o_orderkey % 4 = 0
union all
select md5(cast(o_orderkey as string)), o_orderdate from orders where o_orderkey % 12 = 0""",
    "fx_wallet_balance": """
select o_orderdate as ts, cast(sum(cast(o_totalprice as decimal(20,2))) as decimal(38,8)) as amount
from orders group by o_orderdate""",
    "fx_merge": """
select c_custkey+2 as user_id_main, c_custkey+1 as user_id_merge, 1 as seq from customer where c_custkey % 100 = 10
union all
select c_custkey+3, c_custkey+2, 2 from customer where c_custkey % 100 = 10""",
    # Keywords with the bounds and divisor of their amounts.
    "fx_keyword": """
select * from (values ('flip',4,4,1),('megaflip',4,80,1),('gigaflip',4,800,1),('roll',4,4,1),
 ('megaroll',4,240,1),('gigaroll',4,2400,1),('random250',0,250000,1000),('random500',0,500000,1000),
 ('random1000',0,1000000,1000),('blazeit',420,420,1),('lsd',1967,1967,1),('dogecar',98,98,1),
 ('joshwise',98,98,1),('wutang',36,36,1),('netcodepool',1337,1337,1),('cake',365,365,1))
 as t(keyword,lo,hi,divisor)""",
}

_WORD = re.compile(r"\b[a-z_][a-z0-9_]*\b")


def _needed(sql: str, names: tuple[str, ...] | dict) -> list[str]:
    words = set(_WORD.findall(sql))
    return [n for n in names if n in words]


def recipe_closure(sql: str) -> list[str]:
    """Recipe names that ``sql`` needs, in dependency (declaration) order."""
    needed: set[str] = set()
    frontier = _needed(sql, RECIPES)
    while frontier:
        name = frontier.pop()
        if name not in needed:
            needed.add(name)
            frontier += _needed(RECIPES[name], RECIPES)
    return [n for n in RECIPES if n in needed]


def oracle_text(sql: str) -> str:
    """Prefix an oracle query with the CTEs it uses."""
    ctes = [f"{n} as ({RECIPES[n].strip()})" for n in recipe_closure(sql)]
    body = sql.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return "with " + ",\n".join(ctes) + ",\n" + body[5:]
    return "with " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Lazy access to the driver's parquet and to the derived domain tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run portable SQL over base tables and recipes."""
        recipes = recipe_closure(text)
        everything = text + " ".join(RECIPES[n] for n in recipes)
        ctes = [
            f"{n} as (select * from parquet.`{self.sf_dir}/{n}.parquet`)"
            for n in _needed(everything, BASE_TABLES)
        ]
        ctes += [f"{n} as ({RECIPES[n].strip()})" for n in recipes]
        body = text.strip()
        if not ctes:
            return self.spark.sql(body)
        if body[:5].lower() == "with ":
            return self.spark.sql("with " + ",\n".join(ctes) + ",\n" + body[5:])
        return self.spark.sql("with " + ",\n".join(ctes) + "\n" + body)

    def __getattr__(self, name: str) -> DataFrame:
        key = f"fx_{name}"
        if key not in RECIPES:
            raise AttributeError(name)
        return self.sql(f"select * from {key}")
