"""Listings of crowded addresses against all pairs."""

import random

from metres import metres
from pairs import most_joined

from parcelforge.operators import entity

P, S = "location_id string, suite string, house string, street string, lat double, lon double", "listing_id string, suite string, house string, street string, lat double, lon double"


def expected(homes, offers):
    out, units = {}, {}
    for h in homes:
        units[h[2:4]] = units.get(h[2:4], 0) + 1
    for o in offers:
        sure = []
        for h in (h for h in homes if h[2:4] == o[2:4]):
            far = metres(h[4:], o[4:]) if h[4] is not None and o[4] is not None else 1e9
            near = 0.2 if far <= 15 else 0.1 if far <= 40 else 0.0
            sure.append((-0.96, h[0], "suite_missing_multi_unit") if o[1] is None and units[o[2:4]] > 1 else (-0.99, h[0], "exact_address") if o[1] == h[1] else (-min(0.96, 0.85 + near), h[0], "house_street"))
        if sure:
            sure.sort()
            out[o[0]] = (sure[0][1], sure[0][2], round(-sure[0][0], 6), len(sure) > 1 and sure[1][0] - sure[0][0] < 0.03)
    return out


def test_listings_against_all_pairs(spark):
    rng = random.Random(8)
    place = lambda: rng.choice([(53.5, -113.5), (53.5001, -113.5), (53.5003, -113.5003), (53.51, -113.5), (0.0, 179.9999), (0.0, -179.9999), (None, None), (53.5 + rng.random() / 1000, -113.5)])
    rows = lambda name, n: [(f"{name}{i:03}", rng.choice([None, "1", "2", "3", "4", "5", "6", "7", "8", "9"]), str(rng.randrange(12)), "ELM ST NW", *place()) for i in range(n)]
    homes, offers = rows("h", 90), rows("o", 200)
    got = {r.listing_id: (r.location_id, r.method, round(r.confidence, 6), r.ambiguous) for r in entity.match_listings(spark.createDataFrame(homes, P), spark.createDataFrame(offers, S)).collect()}
    assert got == expected(homes, offers)


def test_listings_of_one_crowded_address_are_not_all_paired(spark):
    rows = lambda name: [(f"{name}{i:04}", str(i % 7) if i % 2 else None, "12", "ELM ST NW", 53.5, -113.5) for i in range(600)]
    got, most = most_joined(spark, lambda: entity.match_listings(spark.createDataFrame(rows("h"), P), spark.createDataFrame(rows("o"), S)).collect())
    assert len(got) == 600 and all(r.ambiguous for r in got)
    assert most < 20_000  # 360,000 pairs
