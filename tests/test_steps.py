"""Trajectories at the edges of weeks, against the SQL twins."""

import datetime as dt
import hashlib

import duckdb
import pytest

from tests.test_oracle import plain
from trailforge.plans import registry

NAMES = "J13_first_hits W02_first_hit_step A07_anchor_groups J17_anchor_reach W03_latest_anchor V17_mixed_advantage V18_token_advantage A23_rollout_summary A26_total_rewards V12_retrieval_reward V13_research_reward V14_shopping_reward V16_completion_reward W05_fatal_mask W06_token_offsets".split()


@pytest.fixture(scope="module")
def edges_of_weeks(tmp_path_factory):
    """Events around the starts of weeks by fractions of a second, before 1970 too."""
    kinds = ("view", "click", "error", "purchase", "signup")
    gold = [int(hashlib.md5(f"0-{pos}".encode()).hexdigest()[:8], 16) % 100 for pos in range(4)]
    rows = []
    for week in (2818, 2819, 2820, -3, -1, 0):
        for n, offset in enumerate((-3_600_000_000, -1_000_000, -500_001, -500_000, -499_999, -1, 0, 499_999, 500_000, 3_600_000_000)):
            for user in range(6):
                k = len(rows)
                at = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=week * 604_800_000_000 + offset)
                rows.append((k, at, user * 20, kinds[(k // 7 + n * user) % 5], float(k % 90), f'{{"k": {gold[k // 3 % 4] if k % 3 == 0 else k * 13 % 100}}}'))
    sf = str(tmp_path_factory.mktemp("weeks"))
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{sf}/events.parquet' (FORMAT parquet)")
    return sf, con


@pytest.mark.parametrize("name", NAMES)
def test_same_weeks(spark, edges_of_weeks, name):
    sf, con = edges_of_weeks
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert want
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr) == want
