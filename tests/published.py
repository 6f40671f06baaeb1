"""Published summaries as far as the tests need them. Fixed values, in the order they were published."""

from __future__ import annotations

import pandas as pd

#: mainshock_id, mainshock_mag, n_events, p, and the people within 10, 25 and 50 km.
MAINSHOCKS = """
us7000e532 6.1 51 0.6401568335313875 72443.04417282622 425992.8376179076 1276983.9703764252
us7000i59t 6.6 53 0.30311680312843636 7932.310272700928 56812.53266811671 444813.9362812862
usb000gcdd 6.6 87 0.9277242698623986 40802.38997167957 162926.0630670225 996480.1561924346
usb000rzmg 6.2 55 0.6607441266551602 37039.43541195671 457832.7602708731 1783311.6353522348
usp000c30u 6.0 34 0.4728222080167709 1569.4360263190906 38085.65329591204 401381.0965705649
usp000fd8a 6.1 33 0.5069815054681815 128770.43398696632 189185.4659566483 602124.3865928499
usp000g650 7.9 1006 1.1326032066589495 2322.444851875305 43365.84055785865 1262426.3806753985
usp000gdw4 6.0 141 0.8121613386479452 14720.5840986434 89825.74625640226 788652.2158613829
"""

#: Of each mainshock: subgroup_type, subgroup, n_events, p and pop_sum_subgroup; a star where the analysis takes it.
SUBGROUPS = {
    ("us7000e532", 6.1): """
        depth all_depth 51 0.6401568335313875 39455030.24921834
        region West_of_ms 25 0.5575472286435172 7712442.710335938 *
        region East_of_ms 26 0.7051857430532015 31742587.5388824 *
        region South_of_ms 26 0.8335151189525962 27819874.123544943 *
        region North_of_ms 25 0.2127540867517485 11635156.125673387 *
        ring 0-400km 51 0.6401568335313875 39455030.24921834
    """,
    ("us7000i59t", 6.6): """
        depth all_depth 53 0.30311680312843636 85959389.0030688
        region East_of_ms 31 0.2506141033412984 80084531.77458161 *
        region South_of_ms 41 0.2 38338722.51185824 *
        ring 0-400km 53 0.30311680312843636 85959389.0030688
        depth all_relaxed 53 0.30311680312843636 85959389.0030688
    """,
    ("usb000gcdd", 6.6): """
        depth all_depth 87 0.9277242698623986 101302789.83691648
        depth 6.3-10km 43 1.1680780799434805 101302789.83691648 *
        depth >=10km 44 0.7502590255676652 101302789.83691648 *
        region East_of_ms 70 0.9965023326205058 95229521.00360271 *
        region South_of_ms 57 0.9177958043610239 55575618.87235384 *
        region North_of_ms 30 0.9495689735853348 45727170.96456265 *
        ring 0-50km 51 1.2947665293199495 996480.1561924348 *
        ring 50-400km 35 0.42625483600907355 100306309.68072404 *
    """,
    ("usb000rzmg", 6.2): """
        depth all_depth 55 0.6607441266551602 117956636.7039841
        region East_of_ms 33 0.6589571785162927 89878628.74596786 *
        region North_of_ms 32 0.4638773435024074 67338878.91011211 *
        ring 0-150km 29 0.9339722826742607 11845243.940902386 *
        ring 150-400km 26 0.2 106111392.76308171 *
        depth all_relaxed 55 0.6607441266551602 117956636.7039841
    """,
    ("usp000c30u", 6.0): """
        depth all_depth 34 0.4728222080167709 55065254.3462928
        ring 0-400km 34 0.4728222080167709 55065254.3462928
        depth all_relaxed 34 0.4728222080167709 55065254.3462928
    """,
    ("usp000fd8a", 6.1): """
        depth all_depth 33 0.5069815054681815 36738620.90443464
        ring 0-400km 33 0.5069815054681815 36738620.90443464
        depth all_relaxed 33 0.5069815054681815 36738620.90443464
    """,
    ("usp000g650", 7.9): """
        depth all_depth 1006 1.1326032066589495 103708031.71959548
        depth 3-10km 906 1.1679408614042288 103708031.71959548 *
        depth 10-17.4km 25 0.8527325311698934 103708031.71959548 *
        depth >=17.4km 75 0.981273850948332 103708031.71959548 *
        region West_of_ms 51 0.9480848928447715 6266247.385872764 *
        region East_of_ms 955 1.15144610973351 97441784.33372273 *
        region South_of_ms 81 0.9491765093386523 81378489.41833831 *
        region North_of_ms 925 1.1511717919355842 22329542.30125717 *
        ring 0-50km 233 1.1741282033984992 1265333.485841476 *
        ring 50-150km 365 1.2196866073448658 29983993.18890537 *
        ring 150-400km 408 1.0396145681894255 72458705.04484864 *
    """,
    ("usp000gdw4", 6.0): """
        depth all_depth 141 0.8121613386479452 135971984.94119447
        depth 4.8-10km 109 0.8940540550530778 135971984.94119447 *
        depth >=10km 32 0.3564819862911696 135971984.94119447 *
        region West_of_ms 126 0.7103750882689944 55447686.14260315 *
        region South_of_ms 128 0.7582220025982522 93490436.86433628 *
        ring 0-50km 25 0.9728667983216229 788652.2158613828 *
        ring 50-150km 31 0.311857149530159 7487104.599252517 *
        ring 150-400km 85 0.7445072289163865 127696228.12608056 *
    """,
}


def mainshocks() -> pd.DataFrame:
    names = ["mainshock_id", "mainshock_mag", "n_events", "p", "pop_sum_10km", "pop_sum_25km", "pop_sum_50km"]
    rows = [x.split() for x in MAINSHOCKS.split("\n") if x]
    return pd.DataFrame([(r[0], float(r[1]), int(r[2]), *map(float, r[3:])) for r in rows], columns=names)


def subgroups() -> pd.DataFrame:
    rows = []
    for (name, mag), text in SUBGROUPS.items():
        for kind, label, n, p, pop, *taken in (x.split() for x in text.split("\n") if x.strip()):
            rows.append((f"{name}|{kind}|{label}", name, kind, label, int(n), float(p), mag, None if pop == "-" else float(pop), bool(taken)))
    return pd.DataFrame(rows, columns=["record_id", "mainshock_id", "subgroup_type", "subgroup", "n_events", "p", "mainshock_mag", "pop_sum_subgroup", "taken"])
