"""Text parsing, file mapping, import and identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallystone.functions import dates, identity, text
from tallystone.operators import importing, mapping
from tallystone.operators.ranking import apart, row_numbers
from tallystone.plans import bank_text
from tallystone.plans.derived import duck, view
from tallystone.plans.registry import query


def _files(spark, sf):
    rows = view(spark, sf, "bank_rows")
    return bank_text.bank_headers(rows), bank_text.bank_records(rows)


def _mapping(spark, sf):
    headers, records = _files(spark, sf)
    return mapping.detect_mapping(headers, records)


def _examined(spark, sf):
    headers, records = _files(spark, sf)
    found = mapping.detect_mapping(headers, records).withColumn(
        "amount_sign", F.lit("outflow-negative")
    )
    return importing.examine(records, headers, found)


# ---- text ------------------------------------------------------------------------


@query("c1_parse_amount", duck("txn", "select id, amount, amount as from_comma from txn"))
def c1(spark, sf):
    rows = view(spark, sf, "txn")
    written = bank_text.render_amount(F.col("amount"), F.expr("part_id % 5"))
    comma = bank_text.render_amount_comma(F.col("amount"))
    return rows.select("id", written.alias("a"), comma.alias("b")).select(
        "id", text.parse_amount(F.col("a")).cast("decimal(18,2)").alias("amount"),
        text.parse_amount(F.col("b"), decimal_comma=True).cast("decimal(18,2)").alias("from_comma"),
    )


@query("c2_normalise_description", duck("ledger", "select id, merchant from ledger"))
def c2(spark, sf):
    rows = view(spark, sf, "ledger")
    written = bank_text.render_description(F.col("merchant"), F.expr("account_id % 6"), F.col("line_no"))
    return rows.select("id", written.alias("d")).select(
        "id", text.normalise_description(F.col("d")).alias("merchant")
    )


@query("c3_parse_date", duck("txn", """
select id, posted_on, case when day(posted_on) <= 12 then case when part_id % 2 = 0 then posted_on
  else make_date(2000 + year(posted_on) % 100, month(posted_on), day(posted_on)) end end as ordered,
  'ambiguous' as refused from txn
"""))
def c3(spark, sf):
    rows = view(spark, sf, "txn").select(
        "id", "posted_on",
        bank_text.render_date(F.col("posted_on"), F.expr(f"part_id % {len(bank_text.DATE_FORMATS)}")).alias("a"),
        F.when(F.expr("part_id % 2 = 0"), F.date_format("posted_on", "dd/MM/yyyy")).otherwise(
            F.date_format("posted_on", "MM.dd.yy")).alias("b"),
        F.when(F.expr("part_id % 2 = 0"), "DAY_FIRST").otherwise("MONTH_FIRST").alias("order"),
    )
    plain = F.lit(dates.AMBIGUOUS)
    rows = rows.withColumn("a", dates.clean(F.col("a"))).withColumn("b", dates.clean(F.col("b")))
    refused = dates.date_error(F.col("b"), plain, dates.parse_date(F.col("b"), plain))
    return rows.select(
        "id", dates.parse_date(F.col("a"), plain).alias("posted_on"),
        F.when(F.dayofmonth("posted_on") <= 12, dates.parse_date(F.col("b"), F.col("order"))).alias("ordered"),
        F.when(refused == "date order is ambiguous", "ambiguous").alias("refused"),
    )


@query("c4_signed_amount", duck("bank_rows", """
select id, case when fault = 'both' then null else amount end as amount from bank_rows"""))
def c4(spark, sf):
    amount, size = F.col("amount"), F.abs("amount").cast("string")
    both = F.col("fault") == "both"
    signed = F.expr("part_id % 3 = 0") & ~both
    rows = view(spark, sf, "bank_rows").select(
        "id", signed.alias("uses_amount"), F.col("flipped").alias("outflow_positive"),
        F.when(F.col("flipped"), -amount).otherwise(amount).cast("string").alias("t_amount"),
        F.when((amount < 0) | both, F.when(F.expr("part_id % 2 = 0"), size).otherwise(
            F.concat(F.lit("-"), size))).alias("t_debit"),
        F.when((amount > 0) | both, size).alias("t_credit"),
    )
    return importing.with_signed_amount(rows).select(
        "id", F.col("value").cast("decimal(18,2)").alias("amount")
    )


@query("c6_account_key", duck("supplier", """
select s_suppkey as account_id, lower(replace(s_name, '#', '-')) as account_key from supplier"""))
def c6(spark, sf):
    named = view(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("account_id"), F.concat(F.lit("  "), F.upper("s_name"), F.lit("!")).alias("name")
    )
    return identity.with_account_key(named, "name").select("account_id", "account_key")


@query("c7_fingerprint", duck("bank_rows", """
select id, substr(sha256(concat_ws(chr(31), account_id::varchar, posted_on::varchar, merchant,
  amount::varchar, currency)), 1, 32) as fingerprint, 1 as version from bank_rows"""))
def c7(spark, sf):
    return importing.with_fingerprint(view(spark, sf, "bank_rows")).select(
        "id", "fingerprint", F.lit(identity.FINGERPRINT_VERSION).alias("version")
    )


@query("c8_rounding", duck("lineitem", """
select id, cents, dollars, even from (select *, (raw / 1000)::decimal(18,3) as x from (
  select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-',
     cast(round(l_extendedprice * 100) as bigint)) as id,
     case when l_partkey % 2 = 0 then -1 else 1 end * cast(round(l_extendedprice * 100) as bigint) as raw,
     abs(raw) as mag, sign(raw) as sg,
     (sg * ((mag + 5) // 10) * 0.01::decimal(9,2))::decimal(18,2) as cents,
     (sg * ((mag + 500) // 1000))::decimal(18,0) as dollars,
     (sg * (mag // 10 + case when mag % 10 > 5 or (mag % 10 = 5 and (mag // 10) % 2 = 1) then 1 else 0 end)
        * 0.01::decimal(9,2))::decimal(18,2) as even
  from lineitem))"""))
def c8(spark, sf):
    # amounts in thousandths, so that ties at half a cent occur
    rows = view(spark, sf, "lineitem").select(
        F.expr("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))").alias("id"),
        F.expr("cast(case when l_partkey % 2 = 0 then -1 else 1 end * cast(round(l_extendedprice * 100) as bigint) as decimal(18,0)) * 0.001").alias("x"),
    )
    return rows.select(
        "id", F.round("x", 2).cast("decimal(18,2)").alias("cents"),
        F.round("x", 0).cast("decimal(18,0)").alias("dollars"),
        F.bround("x", 2).cast("decimal(18,2)").alias("even"),
    )


@query("c9_redact", duck("documents", r"""
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '\p{Nd}', '9', 'g'), '\p{L}', 'X', 'g') as redacted
from documents"""))
def c9(spark, sf):
    return view(spark, sf, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query("c10_digit_share", duck("ledger", r"""
select id, round_even(length(regexp_replace(description, '[^0-9]', '', 'g')) / length(description), 3)::decimal(9,3) as digit_share from ledger"""))
def c10_share(spark, sf):
    return view(spark, sf, "ledger").select("id", text.digit_share(F.col("description")).alias("digit_share"))


@query("c10_row_facts", duck("ledger", r"""
select id, length(description)::int as description_length,
  len(list_filter(regexp_split_to_array(description, '\s+'), lambda w: w <> ''))::int as word_count,
  length(regexp_replace(description, '[^0-9]', '', 'g')) as digits,
  length(description) < 15 as thin from ledger"""))
def c10(spark, sf):
    d = F.col("description")
    return view(spark, sf, "ledger").select(
        "id", F.length(text.strip(d)).alias("description_length"),
        F.size(text.words(d)).alias("word_count"),
        F.regexp_count(d, F.lit(r"\p{Nd}")).cast("bigint").alias("digits"),
        (F.length(text.strip(d)) < 15).alias("thin"),
    )


@query("c11_crude_merchant", duck("documents", r"""
select doc_id, array_to_string(list_filter(regexp_split_to_array(upper(replace(text, 'ß', 'ss')), '\s+'), lambda w: w <> '')[1:2], ' ') as key
from documents"""))
def c11(spark, sf):
    return view(spark, sf, "documents").select("doc_id", text.crude_merchant(F.col("text")).alias("key"))


@query("c22_label_text", duck("txn", """
select distinct label, array_to_string(list_transform(string_split(label, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title,
  case when contains(label, '_') then upper(r[1]) || lower(r[2:]) else '' end as remainder
from (select suggested_label as label, replace(substr(suggested_label, instr(suggested_label, '_') + 1), '_', ' ') as r
      from txn where suggested_label is not null)"""))
def c22(spark, sf):
    labels = view(spark, sf, "txn").select(F.col("suggested_label").alias("label")).distinct()
    return labels.filter("label is not null").select(
        "label", text.label_title(F.col("label")).alias("title"),
        text.label_remainder(F.col("label")).alias("remainder"),
    )


@query("c23_email_key", duck("customer", """
select c_custkey, lower(replace(c_name, '#', '.')) || '@example.com' as email from customer"""))
def c23(spark, sf):
    raw = F.concat(F.lit("  "), F.upper(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@Example.COM \t"))
    return view(spark, sf, "customer").select("c_custkey", text.email_key(raw).alias("email"))


# ---- mapping ---------------------------------------------------------------------

_SHAPES = "select distinct file_id, shape from bank_rows"
_DAY = "bool_or(day(posted_on) > 12 and fault not in ('blank', 'date')) as past_twelve"


@query("b1_header_match", duck("bank_rows", """
select file_id, position, field, rank::int as rank from files join (values
 (0,0,'date',1),(0,1,'description',0),(0,2,'amount',0),
 (1,0,'date',0),(1,1,'merchant',3),(1,2,'debit',4),(1,3,'credit',4),
 (2,0,'date',4),(2,1,'date',2),(2,2,'description',1),(2,3,'amount',0),(2,4,null,null),
 (3,0,null,null),(3,1,'description',3),(3,2,'debit',0),(3,3,'credit',0),(3,4,null,null),
 (4,0,'date',0),(4,1,'description',0),(4,2,'amount',0),(4,3,'debit',0),
 (5,0,'date',0),(5,1,'description',0),(5,2,'amount',0),
 (6,0,'date',0),(6,1,'description',0),(6,2,'amount',0)) v(shape, position, field, rank) using (shape)""",
    files=_SHAPES))
def b1(spark, sf):
    return mapping.header_fields(bank_text.bank_headers(view(spark, sf, "bank_rows"))).select(
        "file_id", "position", "field", "rank"
    )


_COLUMNS = """
select file_id, position, dates as holds_dates, money as holds_money from files join (values
 (0,0,true,false),(0,1,false,false),(0,2,false,true),
 (1,0,true,false),(1,1,false,false),(1,2,false,true),(1,3,false,true),
 (2,0,true,false),(2,1,true,false),(2,2,false,false),(2,3,false,true),(2,4,false,true),
 (3,0,true,false),(3,1,false,false),(3,2,false,true),(3,3,false,true),(3,4,true,false),
 (4,0,true,false),(4,1,false,false),(4,2,false,true),(4,3,false,true),
 (5,0,false,false),(5,1,false,false),(5,2,false,true),
 (6,0,true,false),(6,1,false,false),(6,2,false,true)) v(shape, position, dates, money) using (shape)"""


@query("b2_looks_like_dates", duck("bank_rows", "select file_id, position, holds_dates from cols",
                                   files=_SHAPES, cols=_COLUMNS))
def b2(spark, sf):
    return mapping.column_evidence(*_files(spark, sf)).select("file_id", "position", "holds_dates")


@query("b3_looks_like_amounts", duck("bank_rows", "select file_id, position, holds_money from cols",
                                     files=_SHAPES, cols=_COLUMNS))
def b3(spark, sf):
    return mapping.column_evidence(*_files(spark, sf)).select("file_id", "position", "holds_money")


@query("b4_date_order", duck("bank_rows", f"""
select file_id, case shape when 0 then case when past_twelve then 'MONTH_FIRST' else 'AMBIGUOUS' end
   when 1 then case when past_twelve then 'DAY_FIRST' else 'AMBIGUOUS' end
   when 4 then case when past_twelve then 'MONTH_FIRST' else 'AMBIGUOUS' end
   when 5 then 'AMBIGUOUS' when 6 then 'AMBIGUOUS' else 'ISO' end as date_order
from (select file_id, shape, {_DAY} from bank_rows group by all)"""))
def b4(spark, sf):
    return mapping.column_evidence(*_files(spark, sf)).filter("position = 0").select("file_id", "date_order")


_DETECTED = f"""
select file_id, v.*, case when shape in (4, 5, 6) then 'AMBIGUOUS' when shape in (2, 3) then 'ISO'
   when not past_twelve then 'AMBIGUOUS' when shape = 0 then 'MONTH_FIRST' else 'DAY_FIRST' end as date_order
from (select file_id, shape as s, {_DAY} from bank_rows group by all) join (values
 (0,'Transaction Date','Description',null,'Amount',null,null,'','',''),
 (1,'Date','Name','Name',null,'Money Out','Money In','','',''),
 (2,'Trans. Date','Details',null,'Amount',null,null,'','','date: chose ''Trans. Date'' over Post Date'),
 (3,'When','Narrative',null,null,'Debit','Credit','','date: several columns hold dates (When, Settled)',''),
 (4,'Date','Description',null,'Amount','Debit',null,'both an amount column and a debit/credit pair','',''),
 (5,null,'Description',null,'Amount',null,null,'no date column found','date: column ''Date'' does not contain dates',''),
 (6,'Date','Description',null,'Amount',null,null,'','','')
) v(shape, date, description, merchant, amount, debit, credit, problems, uncertain, resolved) on s = shape"""


@query("b5_detect_mapping", duck("bank_rows", """
select * exclude (shape), problems = '' as mapped from det""", det=_DETECTED))
def b5(spark, sf):
    joined = [F.array_join(n, "; ").alias(n) for n in ("problems", "uncertain", "resolved")]
    return _mapping(spark, sf).select(
        "file_id", "date", "description", "merchant", "amount", "debit", "credit", "date_order",
        "mapped", *joined,
    )


@query("b6_supplied_mapping", duck("bank_rows", """
select file_id, case when shape = 2 then 'Post Date' when shape = 4 then 'Date' else date end as date,
  description, case when shape = 4 then 'Money' else amount end as amount,
  case when shape = 4 then null else debit end as debit,
  shape in (2, 4) or problems = '' as mapped,
  case when shape = 2 then 'ISO' when shape = 4 then 'MONTH_FIRST' else date_order end as date_order,
  case when shape = 2 then 'outflow-positive' else 'outflow-negative' end as amount_sign,
  case when shape = 2 then 'date' else '' end as overridden,
  case when shape = 4 then 'Money' else '' end as unknown_columns
from det""", det=_DETECTED))
def b6(spark, sf):
    headers, records = _files(spark, sf)
    detected = mapping.detect_mapping(headers, records)
    shapes = view(spark, sf, "bank_rows").select("file_id", "shape").distinct()
    none = F.lit(None).cast("string")
    second = F.col("shape") == 2
    supplied = shapes.filter("shape in (2, 4)").select(
        "file_id", F.when(second, "Post Date").otherwise("Date").alias("date"),
        F.when(second, "Details").otherwise("Description").alias("description"),
        none.alias("merchant"), none.alias("external_id"),
        F.when(second, "Amount").otherwise("Money").alias("amount"), none.alias("debit"),
        none.alias("credit"), F.when(second, "ISO").otherwise("MONTH_FIRST").alias("date_order"),
        F.when(second, "outflow-positive").otherwise("outflow-negative").alias("amount_sign"),
    )
    return mapping.apply_overrides(detected, supplied, headers).select(
        "file_id", "date", "description", "amount", "debit", "mapped", "date_order", "amount_sign",
        F.array_join("overridden", "; ").alias("overridden"),
        F.array_join("unknown_columns", "; ").alias("unknown_columns"),
    )


# ---- import ----------------------------------------------------------------------

_STATES = """
select *, case when fault = 'blank' then 'blank' when why is not null then 'error' else 'parsed' end as state,
  case when shape in (0, 2) and flipped then -amount else amount end as read_amount
from (select *, case fault
   when 'surplus' then '1 extra cell(s) beyond the header'
   when 'short' then 'missing cell(s) for: ' || case shape when 0 then 'Amount' when 1 then 'Money In'
        when 2 then 'Balance' when 3 then 'Settled' else 'Amount' end
   when 'date' then 'not a date'
   else case when shape = 6 then 'date order is ambiguous'
      when fault = 'description' then 'description is blank'
      when fault = 'amount' then 'not a valid amount'
      when fault = 'both' and shape in (1, 3) then 'both debit and credit are filled in' end end as why
   from bank_rows where shape not in (4, 5))"""
_PARSED = "select * from states where state = 'parsed'"


@query("c5_row_assembly", duck("bank_rows", """
select file_id, line, state, case when state = 'error' then why end as error,
  case when state = 'parsed' then posted_on end as posted_on,
  case when state = 'parsed' then merchant end as merchant,
  case when state = 'parsed' then read_amount end as amount from states""", states=_STATES))
def c5(spark, sf):
    return _examined(spark, sf).select(
        "file_id", "line", "state", "error", "posted_on", "merchant",
        F.col("amount").cast("decimal(18,2)").alias("amount"),
    )


@query("a2_ragged_rows", duck("bank_rows", """
select file_id, line, why as error from states where fault in ('surplus', 'short')""", states=_STATES))
def a2(spark, sf):
    return _examined(spark, sf).filter(
        "error like '%extra cell(s)%' or error like 'missing cell(s)%'"
    ).select("file_id", "line", "error")


_SUMMARY = """
select file_id, count(*) as source_rows, count(*) filter (where state = 'blank') as blank_rows,
  count(*) filter (where state = 'parsed') as parsed, count(*) filter (where state = 'error') as errors,
  count(*) filter (where state = 'parsed' and read_amount > 0) as positives,
  any_value(shape) in (0, 2, 6) and count(*) filter (where state = 'parsed' and read_amount > 0) * 2
     > count(*) filter (where state = 'parsed') as sign_warning
from states group by file_id"""


@query("a3_blank_rows", duck("bank_rows", "select file_id, source_rows, blank_rows from s",
                             states=_STATES, s=_SUMMARY))
def a3(spark, sf):
    return importing.preview_summary(_examined(spark, sf)).select("file_id", "source_rows", "blank_rows")


@query("b7_sign_warning", duck("bank_rows", "select file_id, parsed, positives, sign_warning from s",
                               states=_STATES, s=_SUMMARY))
def b7(spark, sf):
    return importing.preview_summary(_examined(spark, sf)).select(
        "file_id", "parsed", "positives", "sign_warning"
    )


@query("n1_rows_accounted", duck("bank_rows", """
select file_id, source_rows - blank_rows as transactions, parsed + errors as accounted from s""",
    states=_STATES, s=_SUMMARY))
def n1(spark, sf):
    return importing.preview_summary(_examined(spark, sf)).select(
        "file_id", (F.col("source_rows") - F.col("blank_rows")).alias("transactions"),
        (F.col("parsed") + F.col("errors")).alias("accounted"),
    )


@query("f8_duplicate_groups", duck("bank_rows", """
select file_id, posted_on, merchant, read_amount::decimal(18,2) as amount, count(*) as rows, min(line) as first_line
from parsed group by 1, 2, 3, 4 having count(*) > 1""", states=_STATES, parsed=_PARSED))
def f8(spark, sf):
    return importing.duplicate_groups(_examined(spark, sf).filter("state = 'parsed'"))


@query("f8_duplicate_lines", duck("bank_rows", """
select file_id, line, first_line, posted_on, merchant, read_amount::decimal(18,2) as amount
from (select *, min(line) over (partition by file_id, posted_on, merchant, read_amount) as first_line,
        count(*) over (partition by file_id, posted_on, merchant, read_amount) as n from parsed) where n > 1""", states=_STATES, parsed=_PARSED))
def f8_lines(spark, sf):
    return importing.duplicate_lines(_examined(spark, sf).filter("state = 'parsed'"))


@query("g1_occurrence", duck("bank_rows", """
select id, row_number() over (partition by account_id, file_id, posted_on, merchant, amount
                              order by line, id) as occurrence from bank_rows"""))
def g1(spark, sf):
    return importing.number_occurrences(view(spark, sf, "bank_rows"), "id").select("id", "occurrence")


@query("d7_outside_window", duck("bank_rows", """
select file_id, count(*) as outside, array_to_string(list(line order by line)[1:10], ', ') as first_lines
from bank_rows where posted_on < make_date(file_year, 2, 1) or posted_on > make_date(file_year, 9, 15)
group by file_id"""))
def d7(spark, sf):
    rows = view(spark, sf, "bank_rows")
    windows = rows.select("file_id", "file_year").distinct().select(
        "file_id", F.expr("make_date(file_year, 2, 1)").alias("window_start"),
        F.expr("make_date(file_year, 9, 15)").alias("window_end"),
    )
    return importing.outside_window(rows.drop("file_year"), windows)


@query("d7_lines_outside", duck("bank_rows", """
select file_id, line, posted_on, make_date(file_year, 2, 1) as window_start, make_date(file_year, 9, 15) as window_end
from bank_rows where posted_on < make_date(file_year, 2, 1) or posted_on > make_date(file_year, 9, 15)"""))
def d7_lines(spark, sf):
    # every line outside its window; the refusal names the first ten
    rows = view(spark, sf, "bank_rows")
    windows = rows.select("file_id", "file_year").distinct().select(
        "file_id", F.expr("make_date(file_year, 2, 1)").alias("window_start"),
        F.expr("make_date(file_year, 9, 15)").alias("window_end"),
    )
    return importing.lines_outside(rows.select("file_id", "line", "posted_on"), windows)


@query("d8_incremental_refusals", duck("bank_rows", """
select file_id, any_value(shape) <> 5 as has_id_column,
  coalesce(sum(n) filter (where x is null or x = ''), 0)::bigint as blank_ids,
  count(*) filter (where x <> '' and n > 1) as repeated_ids
from (select file_id, any_value(shape) as shape, count(*) as n,
        case when part_id % 50 = 0 then '' when part_id % 31 = 0 then 'T-' || (order_id % 3)
             else external_id end as x from bank_rows group by file_id, x) group by file_id"""))
def d8(spark, sf):
    rows = view(spark, sf, "bank_rows").withColumn(
        "external_id",
        F.expr("case when part_id % 50 = 0 then '' when part_id % 31 = 0 then concat('T-', order_id % 3) else external_id end"),
    )
    return importing.incremental_refusals(rows, F.col("shape") != 5)


@query("d13_mode_conflicts", duck("batches", """
select batch_id, d.account_id, d.mode from deliveries d
where exists (select 1 from batches b where b.account_id = d.account_id and b.mode <> d.mode)""",
    deliveries="""select o_orderkey as batch_id, o_custkey % 140 as account_id,
      case when o_orderkey % 4 = 0 then 'incremental' else 'snapshot' end as mode from orders"""))
def d13(spark, sf):
    deliveries = view(spark, sf, "orders").selectExpr(
        "o_orderkey as batch_id", "o_custkey % 140 as account_id",
        "case when o_orderkey % 4 = 0 then 'incremental' else 'snapshot' end as mode",
    )
    return importing.mode_conflicts(deliveries, view(spark, sf, "batches"))


@query("a4_new_deliveries", duck("batches", """
select batch_id, account_id, source_sha256 from batches d where batch_id % 3 <> 0
and not exists (select 1 from batches b where b.batch_id % 3 = 0 and b.account_id = d.account_id
                and b.source_sha256 = d.source_sha256)
qualify row_number() over (partition by account_id, source_sha256 order by batch_id) = 1"""))
def a4(spark, sf):
    batches = view(spark, sf, "batches")
    fresh = importing.new_deliveries(
        batches.filter("batch_id % 3 <> 0"), batches.filter("batch_id % 3 = 0")
    )
    return fresh.select("batch_id", "account_id", "source_sha256")


# Charges already stored by an earlier run, and the run being resolved: half of each
# account's rows arrive in two overlapping files.
_FP = """substr(sha256(concat_ws(chr(31), account_id::varchar, posted_on::varchar, merchant,
  amount::varchar, currency)), 1, 32)"""
_STORED = f"""select *, {_FP} as fingerprint, row_number() over (partition by account_id, file_id,
  posted_on, merchant, amount order by line, id) as occurrence from stored_rows"""
_RUN = f"""select *, {_FP} as fingerprint, row_number() over (partition by account_id, delivery,
  posted_on, merchant, amount order by line, id) as occurrence
 from (select *, 1 as delivery from bank_rows where part_id % 2 = 0
       union all select *, 2 from bank_rows where part_id % 4 <> 0)"""


def _numbered_charges(rows, whole=False):
    return importing.number_occurrences(importing.with_fingerprint(rows), "id", whole)


def _stored(spark, sf):
    return _numbered_charges(view(spark, sf, "stored_rows"))


def _run(spark, sf):
    rows = view(spark, sf, "bank_rows")
    both = rows.filter("part_id % 2 = 0").withColumn("file_order", F.lit(1)).unionByName(
        rows.filter("part_id % 4 <> 0").withColumn("file_order", F.lit(2))
    )
    return both.withColumn("file_id", F.concat_ws("/", "file_id", "file_order"))


def _resolved(spark, sf, resolve):
    """The run against what is stored: both are moved once, by account, before they grow by their marks."""
    def work(run, stored, whole):
        return resolve(_numbered_charges(run, whole), _numbered_charges(stored, whole), whole)

    return apart(work, ["account_id"], _run(spark, sf), view(spark, sf, "stored_rows"))


_E2 = """
select r.id, r.file_id || '/' || r.delivery as file_id, r.occurrence,
  exists (select 1 from stored s where s.account_id = r.account_id and s.fingerprint = r.fingerprint
          and s.occurrence = r.occurrence)
  or exists (select 1 from run o where o.account_id = r.account_id and o.fingerprint = r.fingerprint
          and o.occurrence = r.occurrence and o.delivery < r.delivery) as already_stored
from run r"""


@query("e2_snapshot_resolution", duck("stored_rows", _E2, stored=_STORED, run=_RUN))
def e2(spark, sf):
    return _resolved(spark, sf, importing.resolve_snapshot).select(
        "id", "file_id", "occurrence", "already_stored"
    )


_OUTCOME = """select file_id, count(*) as attempted, count(*) filter (where not already_stored) as imported,
  count(*) filter (where already_stored) as already_stored from resolved group by file_id"""


@query("f35_import_outcome", duck("stored_rows", _OUTCOME, stored=_STORED, run=_RUN, resolved=_E2))
def f35(spark, sf):
    return importing.import_outcome(_resolved(spark, sf, importing.resolve_snapshot))


_E3 = """
select id, file_id || '/' || delivery as file_id, occurrence, already_stored,
  case when not already_stored then occurrence + coalesce(highest, 0)
       + coalesce(case when delivery = 2 then first_top end, 0) end as stored_occurrence
from (select *, max(case when delivery = 1 and not already_stored then occurrence end)
         over (partition by account_id, fingerprint) as first_top
      from (select r.*, h.highest,
              exists (select 1 from stored s where s.account_id = r.account_id and s.external_id = r.external_id)
              or exists (select 1 from run o where o.account_id = r.account_id
                         and o.external_id = r.external_id and o.delivery < r.delivery) as already_stored
            from run r left join (select account_id, fingerprint, max(occurrence) as highest
                                  from stored group by all) h using (account_id, fingerprint)))"""


@query("e3_incremental_resolution", duck("stored_rows", _E3, stored=_STORED, run=_RUN))
def e3(spark, sf):
    return _resolved(spark, sf, importing.resolve_incremental).select(
        "id", "file_id", "occurrence", "already_stored", "stored_occurrence"
    )


@query("f36_manual_entries", duck("stored_rows", """
select seq, account_id, fingerprint, stores as stored,
  coalesce(highest, 0) + sum(case when stores then 1 else 0 end) over
    (partition by account_id, fingerprint order by seq)::bigint as occurrence
from (select e.*, h.highest, e.part_id % 10 = 0 or (h.highest is null and row_number() over
        (partition by e.account_id, e.fingerprint order by seq) = 1) as stores
      from entries e left join (select account_id, fingerprint, max(occurrence) as highest
                                from stored group by all) h using (account_id, fingerprint))""",
    stored=_STORED, entries=f"""select *, {_FP} as fingerprint,
      row_number() over (order by id) as seq from bank_rows"""))
def f36(spark, sf):
    rows, stored = view(spark, sf, "bank_rows"), view(spark, sf, "stored_rows")
    # entry order of the batch: a global number from per-account counts, no single sort task
    entries = _numbered(rows).withColumn("repeat", F.expr("part_id % 10 = 0"))

    def work(entered, stored, whole):
        marked = importing.with_fingerprint(entered).select("seq", "account_id", "fingerprint", "repeat")
        return importing.enter_manually(marked, _numbered_charges(stored, whole), whole)

    return apart(work, ["account_id"], entries, stored, counted=[rows, stored])


def _numbered(rows):
    # chunks by the first two characters follow the string order of the ids
    cut = rows.withColumn("all_rows", F.lit(0))
    return row_numbers(cut, ["all_rows"], F.rpad(F.substring("id", 1, 3), 3, " "), ["id"], "seq").drop("all_rows")


@query("n7_fingerprint_recomputes", duck("stored_rows", f"""
select count(*) as rows, count(*) filter (where {_FP} <> fingerprint) as breaks from stored""", stored=_STORED))
def n7(spark, sf):
    stored = _stored(spark, sf)
    total = stored.agg(F.count("*").alias("rows")).withColumn("k", F.lit(1))
    broken = importing.fingerprint_breaks(stored).agg(F.count("*").alias("breaks"))
    return total.join(broken.withColumn("k", F.lit(1)), "k").drop("k")
