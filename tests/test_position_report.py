"""position_report against its SQL on accounts that the generated tables do not have."""

from datetime import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from __spark_entry__ import oracle_sql, queries


def test_negative_missing_and_repeated_accounts(spark, tmp_path):
    day = datetime(2001, 3, 1)
    accounts = [(1, 500.0), (2, -999.0), (3, 10.0), (3, 10.0)]  # 4 and null have no cash
    owners = [1, 1, 2, 2, 3, 3, 4, None, None]
    tables = {
        "customer": {"c_custkey": [k for k, _ in accounts], "c_acctbal": [c for _, c in accounts]},
        "orders": {"o_orderkey": list(range(len(owners))),
                   "o_custkey": pa.array(owners, pa.int64())},
        "lineitem": {"l_orderkey": list(range(len(owners))), "l_partkey": list(range(len(owners))),
                     "l_suppkey": [i % 2 for i in range(len(owners))],
                     "l_linenumber": pa.array([1] * len(owners), pa.int32()),
                     "l_quantity": [float(i + 1) for i in range(len(owners))],
                     "l_extendedprice": [7.0 * (i + 1) for i in range(len(owners))],
                     "l_returnflag": ["N"] * len(owners),
                     "l_shipdate": [day] * len(owners)},
    }
    con = duckdb.connect()
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    names = ["account", "symbol", "shares", "locked_shares", "last_price", "market_value", "weight"]
    found = queries()["position_report"](spark, str(tmp_path))
    result = con.execute(f"select {', '.join(names)} from ({oracle_sql()['position_report']})")
    want = sorted(result.fetchall(), key=repr)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == want
    assert any(row[-1] < 0 for row in want)
