"""Every operator with a SQL statement gives the same rows as that statement."""

import os

import pytest

import checks
from checks.compare import canon, connect

from .conftest import DATA

checks.load_all()
# A few of every family by default; TALLYMAST_ALL=1 runs every statement (about ten minutes).
SOME = (
    "S4 S6 P1_ P2 P5 P6 P11 P18_filter_location V2_cdr V6 V14 V15 V22 A1 A4 D1 D2 T1 T4_burst T5 T6 C2 C3 C5 C6 B1 B3 L2 L4 L5 N2 N5 N8_synchronized N9 I2_encryption_flags I7 "
    "I13 I18 I21 I23 W5 W6 W7 H3 H4 H8 E2 E5 E7 M1_ M5 M7_quick_visits M8 M10 M12 M15 G4 G6 G7 G8_perimeter G10_n G12 Q1_ Q7_c Q9 Q11_i Q13 Q14 X1_ X3_link_calls X6 X7_profiles X9 "
    "K2 K4 K6 K9 K12 R2_cdr_risk_c R4 Z2 Z6 Z8_appearance_c J1_ J7").split()
NAMES = [n for n in checks.ORACLES if os.environ.get("TALLYMAST_ALL") or n.startswith(tuple(SOME))]


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, name):
    df = checks.QUERIES[name](spark, DATA)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    cur = duck.execute(checks.ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == canon(cur.fetchall(), cols)
