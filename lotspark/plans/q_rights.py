"""Rights, tenants and payouts of every lot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import RIGHT_KINDS, right_kind
from ..operators import payout, rights
from ..sources.driver_tables import oracle, table
from .q_scalars import _chain

c = F.col


def _rights(spark, d):
    return table(spark, d, "rights").withColumn("kind", right_kind(c("purpose")))


def a1_baselines(spark, d):
    return rights.baselines(_rights(spark, d))


def r1_right_verdicts(spark, d):
    return rights.judge_rights(_rights(spark, d)).select("lot", "seq", "kind", "reg_date", "base_date", "verdict", "reason")


def r2_tenant_verdicts(spark, d):
    t = table(spark, d, "tenants")
    return rights.judge_tenants(t, rights.baselines(_rights(spark, d)).select("lot", "base_date")).select("lot", "seq", "has_power", "assumes", "recheck")


def a4_rights_analysis(spark, d):
    return rights.analyse(_rights(spark, d), table(spark, d, "tenants"))


def f5_collection_policy(spark, d):
    return rights.screened(_rights(spark, d)).select("lot", F.array_join("reasons", ",").alias("reasons"))


def a14_merged_tenants(spark, d):
    return rights.merged_tenants(table(spark, d, "tenants"))


def a5_crawler_risk(spark, d):
    t = table(spark, d, "tenants").join(rights.baselines(_rights(spark, d)).select("lot", "base_date"), "lot", "left")
    t = t.select("lot", F.when(c("occupant") == 1, c("deposit")).alias("assume"), "deposit", (c("occupant") == 2).alias("power"), (c("seq") % 5 == 0).alias("waived"), "move_in", "base_date")
    takes = rights.judge_rights(_rights(spark, d)).where("verdict = '인수' and reason = 'demolition'")
    return rights.risk_by_crawler(t, takes)


def _entries(spark, d):
    r = table(spark, d, "rights")
    return r.select("lot", "seq", F.when(c("seq") % 2 == 0, "갑").otherwise("을").alias("section"), c("seq").cast("int").alias("rank"), F.when(c("amount") % 7000 == 0, "cancel").when(c("amount") % 11000 == 0, "correct").otherwise("set").alias("action"), F.greatest(F.lit(1), c("seq") - 2).cast("int").alias("target"), F.concat(F.lit("h"), c("amount").cast("string")).alias("holder"))


def w7_live_entries(spark, d):
    return rights.live_entries(_entries(spark, d)).select("lot", "section", "rank", "holder")


def w8_summary_liens(spark, d):
    r = _rights(spark, d).withColumn("holder", F.when(c("seq") % 3 == 0, "").otherwise(F.concat(F.lit("h"), c("amount").cast("string"))))
    summary = r.where("kind in ('mortgage', 'seizure', 'prov_seizure')").select("lot", "seq", "kind", "reg_date", F.when(c("seq") % 2 == 0, "국").otherwise("").alias("holder"), F.when(c("seq") % 2 == 0, c("amount")).otherwise(0).alias("amount"))
    return rights.liens_by_summary(r.select("lot", "seq", "kind", "reg_date", "holder", "amount"), summary)


def _lots(spark, d):
    o = table(spark, d, "orders")
    base = rights.baselines(_rights(spark, d)).select("lot", "base_date")
    region = F.element_at(F.array(*map(F.lit, ("seoul", "overconcentration", "metro", "other"))), (c("o_custkey") % 4 + 1).cast("int"))
    return o.select(c("o_orderkey").alias("lot"), (F.floor(c("o_totalprice") * 0.8) * 1000).cast("long").alias("fund"), region.alias("region")).join(base, "lot", "left")


def _paid(spark, d):
    t = table(spark, d, "tenants")
    claims = payout.claims_of(_rights(spark, d), t)
    return payout.distribute(_lots(spark, d), t, claims, payout.limit_table(spark))


def j3_limits(spark, d):
    return payout.with_limits(_lots(spark, d), payout.limit_table(spark)).select("lot", "max_deposit", "max_priority")


def w1_payouts(spark, d):
    return _paid(spark, d)[0].select("lot", "seq", "stage", "paid")


def w4_recoveries(spark, d):
    return _paid(spark, d)[1]


def w3_lot_totals(spark, d):
    return _paid(spark, d)[2]


def price_curve(spark, d):
    """Assumed deposits at 60, 80 and 100 % of a lot's price: the payout over a grid that is exploded once lots are dealt."""
    t = table(spark, d, "tenants")
    claims = payout.claims_of(_rights(spark, d), t)
    out = payout.distribute(_lots(spark, d), t, claims, payout.limit_table(spark), shares=[60, 80, 100])[2]
    return out.select("lot", "pct", "fund", "paid", "assumed")


_R = f"""r as (select *, {_chain("replace(purpose, ' ', '')", RIGHT_KINDS)} as kind from rights),
cand as (select * from r where kind in ('mortgage', 'seizure', 'prov_seizure', 'security', 'auction_start') or (kind = 'jeonse' and whole and demanded)),
base as (select lot, arg_min(reg_date, (reg_date, seq)) as base_date, arg_min(seq, (reg_date, seq)) as base_seq from cand group by lot),
jr as (select r.*, base_date, base_seq,
  case when kind = 'ownership' then 'owner' when base_date is null then 'no_baseline' when r.seq = base_seq then 'baseline'
    when reg_date >= base_date and kind = 'injunction' and contains(note, '철거') then 'demolition' when reg_date >= base_date then 'junior'
    when kind in ('jeonse', 'surface', 'easement', 'lease', 'ownership_prov', 'injunction', 'repurchase') then 'senior' else 'senior_money' end as reason
  from r left join base using (lot)),
j as (select *, case reason when 'owner' then '소유권' when 'no_baseline' then '인수' when 'baseline' then '말소기준권리' when 'demolition' then '인수' when 'senior' then '인수' else '소멸' end as verdict from jr),
jt as (select t.*, base_date, case when base_date is null then move_in is not null else coalesce(move_in + 1 <= base_date, false) end as has_power from tenants t left join base using (lot)),
vt as (select *, case when has_power and not demanded then deposit else 0 end as assumes, has_power and demanded as recheck from jt)"""

_LIM = ", ".join(f"('{r}', date '{d}', {a}, {b})" for r, d, a, b in payout.LIMITS)
_PAY = f"""{_R},
lim0 as (select * from (values {_LIM}) v(region, eff, max_deposit, max_priority)),
lots0 as (select o_orderkey as lot, cast(floor(o_totalprice * 0.8) as bigint) * 1000 as fund, ['seoul', 'overconcentration', 'metro', 'other'][o_custkey % 4 + 1] as region, base_date from orders left join base on o_orderkey = lot),
lt as (select l.*, coalesce(x.max_deposit, y.max_deposit) as max_deposit, coalesce(x.max_priority, y.max_priority) as max_priority
  from lots0 l asof left join lim0 x on l.region = x.region and l.base_date >= x.eff join (select region, arg_min(max_deposit, eff) as max_deposit, arg_min(max_priority, eff) as max_priority from lim0 group by region) y on l.region = y.region),
sm as (select t.lot, t.seq, t.deposit, least(deposit, max_priority) as due, fund // 2 as half, sum(least(deposit, max_priority)) over (partition by t.lot) as total
  from tenants t join lt using (lot) where demanded and move_in is not null and deposit <= max_deposit),
sp as (select lot, seq, case when total <= half then due else (half::hugeint * due // total)::bigint end as paid from sm),
rest1 as (select lt.lot, fund - coalesce(sum(paid), 0) as rest from lt left join sp using (lot) group by lt.lot, fund),
pc as (select lot, seq, amount, reg_date as pdate, null::bigint as tenant from r where kind in ('mortgage', 'jeonse')
  union all select lot, seq + 1000000, deposit, greatest(fixed, move_in + 1), seq from tenants where demanded and fixed is not null and move_in is not null),
pq as (select pc.lot, pc.seq, tenant, greatest(0, amount - coalesce(paid, 0)) as claim, pdate, rest from pc left join sp on pc.lot = sp.lot and pc.tenant = sp.seq join rest1 on pc.lot = rest1.lot),
pp as (select lot, seq, tenant, greatest(0, least(claim, rest - coalesce(sum(claim) over (partition by lot order by pdate, seq rows between unbounded preceding and 1 preceding), 0))) as paid from pq),
rest2 as (select rest1.lot, rest - coalesce(sum(paid), 0) as rest from rest1 left join pp using (lot) group by rest1.lot, rest),
gc as (select r.lot, r.seq, amount, rest, sum(amount) over (partition by r.lot) as total from r join rest2 using (lot) where kind in ('prov_seizure', 'seizure')),
gp as (select lot, seq, least(amount, (rest::hugeint * amount // total)::bigint) as paid from gc where rest > 0 and total > 0),
po as (select lot, seq, seq as tenant, 'small' as stage, paid from sp union all select lot, seq, tenant, 'priority', paid from pp where paid > 0 union all select lot, seq, null, 'general', paid from gp),
rc as (select t.lot, t.seq, coalesce(g.received, 0) as received, case when t.move_in + 1 <= lt.base_date then greatest(0, t.deposit - coalesce(g.received, 0)) else 0 end as assumes
  from tenants t join lt using (lot) left join (select lot, tenant, sum(paid) as received from po where tenant is not null group by 1, 2) g on t.lot = g.lot and t.seq = g.tenant)"""

_FUND = "cast(floor(o_totalprice * 0.8) as bigint) * 1000"
_TOTALS = "select lt.lot, fund, coalesce(p.paid, 0)::bigint as paid, (fund - coalesce(p.paid, 0))::bigint as leftover, coalesce(a.assumed, 0)::bigint as assumed from lt left join (select lot, sum(paid) as paid from po group by 1) p using (lot) left join (select lot, sum(assumes) as assumed from rc group by 1) a using (lot)"
QUERIES = {f.__name__: f for f in (a1_baselines, r1_right_verdicts, r2_tenant_verdicts, a4_rights_analysis, f5_collection_policy, a14_merged_tenants, a5_crawler_risk, w7_live_entries, w8_summary_liens, j3_limits, w1_payouts, w4_recoveries, w3_lot_totals, price_curve)}
ORACLES = {
    "a1_baselines": oracle(f"with {_R} select * from base"),
    "r1_right_verdicts": oracle(f"with {_R} select lot, seq, kind, reg_date, base_date, verdict, reason from j"),
    "r2_tenant_verdicts": oracle(f"with {_R} select lot, seq, has_power, assumes, recheck from vt"),
    "a4_rights_analysis": oracle(f"""with {_R},
      a as (select lot, max(base_date) as base_date, sum(case when verdict = '인수' then amount else 0 end) as assumed, bool_or(verdict = '인수') as takes, count(*) filter (kind in ('ownership_prov', 'injunction')) as risky from j group by lot),
      b as (select lot, sum(assumes) as deposits, bool_or(has_power) as power, count(*) filter (recheck) as rechecks from vt group by lot),
      m as (select coalesce(a.lot, b.lot) as lot, base_date, coalesce(assumed, 0) + coalesce(deposits, 0) as assumed, base_date is null or coalesce(risky, 0) > 0 or coalesce(power, false) as review,
        coalesce(risky, 0) + coalesce(rechecks, 0) + case when base_date is null then 1 else 0 end as warnings, coalesce(takes, false) as takes from a full join b on a.lot = b.lot)
      select lot, base_date, assumed::bigint as assumed, review, warnings::bigint as warnings, case when assumed > 0 or takes then '위험' when review then '주의' else '안전' end as risk from m"""),
    "f5_collection_policy": oracle(f"with {_R} select lot, case when bool_or(kind = 'ownership_prov' and (base_date is null or reg_date < base_date)) then 'senior_ownership_registration' else '' end as reasons from j group by lot"),
    "a14_merged_tenants": oracle("""select lot, occupant, min(seq) as seq, arg_min(move_in, seq) filter (move_in is not null) as move_in, arg_min(fixed, seq) filter (fixed is not null) as fixed, max(deposit) as deposit, bool_or(demanded) as demanded from tenants group by 1, 2"""),
    "a5_crawler_risk": oracle(f"""with {_R},
      k as (select lot, deposit, occupant = 2 or coalesce(move_in < base_date, false) as power, seq % 5 = 0 as waived, case when seq % 5 = 0 then 0 when occupant = 1 then deposit else 0 end as kept from jt),
      s as (select lot, sum(case when kept = 0 and power and deposit > 0 then deposit else kept end)::bigint as assumed, bool_or(power and not waived) as power from k group by lot)
      select s.lot, assumed, case when assumed > 0 or x.lot is not null then '위험' when power then '주의' else '안전' end as risk from s left join (select distinct lot from j where reason = 'demolition') x on s.lot = x.lot"""),
    "w7_live_entries": oracle("""with e as (select lot, seq, case when seq % 2 = 0 then '갑' else '을' end as section, seq::int as rank, case when amount % 7000 = 0 then 'cancel' when amount % 11000 = 0 then 'correct' else 'set' end as action, greatest(1, seq - 2)::int as target, 'h' || amount as holder from rights)
      select e.lot, e.section, e.rank, coalesce(f.h, e.holder) as holder from e left join (select lot, section, target, arg_max(holder, seq) as h from e where action = 'correct' group by 1, 2, 3) f on e.lot = f.lot and e.section = f.section and e.rank = f.target
      where action = 'set' and not exists (select 1 from e x where x.action = 'cancel' and x.lot = e.lot and x.section = e.section and x.target = e.rank)"""),
    "w8_summary_liens": oracle(f"""with {_R},
      b as (select lot, seq, kind, reg_date, case when seq % 3 = 0 then '' else 'h' || amount end as holder, amount from r),
      s as (select lot, seq, kind, reg_date, case when seq % 2 = 0 then '국' else '' end as holder, case when seq % 2 = 0 then amount else 0 end as amount from b where kind in ('mortgage', 'seizure', 'prov_seizure')),
      f as (select lot, kind, reg_date, arg_min(holder, seq) filter (holder <> '') as h, arg_max(amount, seq) filter (amount > 0) as m from b group by 1, 2, 3)
      select lot, kind, reg_date, holder, amount from b where kind = 'ownership' union
      select s.lot, s.kind, s.reg_date, case when s.holder in ('', '국') and h is not null then h else s.holder end, coalesce(nullif(s.amount, 0), m, 0) from s left join f on s.lot = f.lot and s.kind is not distinct from f.kind and s.reg_date = f.reg_date"""),
    "j3_limits": oracle(f"with {_PAY} select lot, max_deposit, max_priority from lt"),
    "w1_payouts": oracle(f"with {_PAY} select lot, seq, stage, paid from po"),
    "w4_recoveries": oracle(f"with {_PAY} select lot, seq, received::bigint as received, assumes::bigint as assumes from rc"),
    "w3_lot_totals": oracle(f"with {_PAY} {_TOTALS}"),
    "price_curve": oracle(" union all ".join(f"select lot, {n} as pct, fund, paid, assumed from (with {_PAY.replace(_FUND, f'{_FUND} * {n} // 100')} {_TOTALS})" for n in (60, 80, 100))),
}
