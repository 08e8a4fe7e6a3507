from postgrain.operators import cluster

LONG = "describe one thing about you that we would not find on your resume"
ROWS = [  # id, label, kind
    (1, "email", "text"), (2, "your e mail address", "file"), (3, LONG, "textarea"),
    (4, "are you authorised to work in the us", "select"), (5, "are you authorized to work in india", "boolean"), (6, "visa sponsorship for us or india", "text"),
    (7, "college name", "text"), (8, "school", "text"),
    (9, "a b c d e f g h i", "text"), (10, "a b c d e f g h j", "select"), (11, "a b c d e f x y z", "text"), (12, None, "text"), (13, " ".join(["email"] * 41), "text"),
]


def test_rules_come_before_leaders(spark):
    d = spark.createDataFrame(ROWS, "id bigint, k string, t string")
    got = {r["label"]: (r["cluster"], r["how"], r["reasons"]) for r in cluster.question_clusters(d, label="k", raw="k", kind="t", row="id").collect()}
    assert len(got) == len(ROWS)
    assert got["email"] == got["your e mail address"] == ("email", "rule", ["answer kinds differ: file 1, free text 1"])
    assert got[LONG] == ("custom.describe_one_thing_about_you_that", "exact", [])
    assert got[ROWS[3][1]][0] == "work_authorization.us" and got[ROWS[4][1]][0] == "work_authorization.india"
    assert got[ROWS[5][1]] == ("visa_sponsorship", "rule", ["phrasings name different countries: india, us"])
    assert got["college name"] == got["school"] == ("university", "rule", ["claimed by a broad rule; check every phrasing belongs"])
    assert got[ROWS[8][1]] == got[ROWS[9][1]] == ("custom.a_b_c_d_e_f", "similarity", ["merged 2 different phrasings by word overlap", "answer kinds differ: choice 1, free text 1"])
    assert got[ROWS[10][1]] == ("custom.a_b_c_d_e_f_", "exact", [])
    assert got[""] == ("custom.unlabelled", "exact", []) and got[ROWS[12][1]][1] == "exact"


def test_components_give_what_one_pass_gives(spark):
    import random

    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    labels = {" ".join(sorted(rng.sample(words, rng.randint(2, 7)))) for _ in range(60)}
    for x in list(labels):
        ws = x.split()
        labels |= {" ".join([*ws, rng.choice(words)]) for _ in range(2)} | {" ".join(ws[1:])}
    d = spark.createDataFrame([(i, x) for i, x in enumerate(sorted(labels)) for _ in range(1 + i % 3)] + [(999, None), (999, " ")], "id bigint, k string")
    one = sorted(map(tuple, cluster.leader_clusters(d, label="k", row="id", threshold=0.6).collect()))
    many = sorted(map(tuple, cluster.leader_clusters(d, label="k", row="id", threshold=0.6, max_labels=5).collect()))
    assert one == many and len({c for _, c, _ in one}) < len(one)
