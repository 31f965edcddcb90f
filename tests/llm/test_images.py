import numpy as np
from chromloom.llm import images as im


def media(n=40, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        picture = im.draw(r.normal(size=64))
        rows.append((i * 10, im.write_pgm(picture)))
        if i % 4 == 0:
            rows += [(i * 10 + how, im.write_pgm(im.edited(picture, how))) for how in (1, 2)]
        if i % 5 == 0:
            rows.append((i * 10 + 3, im.write_pgm(picture)))
    return rows


def test_edited_copies_and_no_others(spark):
    rows = media()
    got = {r["id"]: r["class_id"] for r in im.image_classes(spark.createDataFrame(rows, "media_id long, data binary")).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def plain_votes(a, b):
    """Counts the corners of each cell of turn, scale and shift one match at a time; a, b: corners (x, y, angle, scale, bits)."""
    ones, twos = {}, {}
    for p, (x1, y1, angle1, scale1, bits1) in enumerate(a):
        for q, (x2, y2, angle2, scale2, bits2) in enumerate(b):
            if (bits1 ^ bits2).bit_count() > im.MAX_DISTANCE:
                continue
            turn, grow = (angle2 - angle1) % 360, scale2 / scale1
            c, s = np.cos(np.radians(turn)), np.sin(np.radians(turn))
            dx, dy = x2 - grow * (x1 * c - y1 * s), y2 - grow * (x1 * s + y1 * c)
            cells = [[("whole", n if not around else n % around), ("half", h if not around else h % around)] for v, width, around in ((turn, im.TURN, 360 // im.TURN), (dx, im.SHIFT, 0), (dy, im.SHIFT, 0)) for n in [v // width] for h in [(v + width / 2) // width]]
            for cell in [(t, dx_, dy_, round(2 * np.log2(grow))) for t in cells[0] for dx_ in cells[1] for dy_ in cells[2]]:
                ones.setdefault(cell, set()).add(p)
                twos.setdefault(cell, set()).add(q)
    return max((min(len(ones[c]), len(twos[c])) for c in ones), default=0)


def corners_of(nodes):
    return {r["id"]: [(*map(float, g), int.from_bytes(r["bits"][32 * k : 32 * k + 32], "little")) for k, g in enumerate(zip(r["x"], r["y"], r["angle"], r["scale"], strict=True))] for r in nodes.collect()}


def plain_links(nodes):
    corners = corners_of(nodes)
    return {(a, b): n for a in corners for b in corners if a < b and (n := plain_votes(corners[a], corners[b])) >= im.MIN_VOTES}


def test_links_against_every_pair(spark):
    picture = im.draw(np.arange(64.0))
    noisy = [(1000 + k, im.write_pgm(np.clip(picture.astype(int) + np.random.default_rng(k).integers(-3, 4, picture.shape), 0, 255))) for k in range(40)]
    rows = [r for r in media(24, 2) if r[0] % 10 != 3] + noisy
    nodes = im.descriptors(spark.createDataFrame(rows, "id long, data binary")).withColumn("node", im.F.monotonically_increasing_id()).persist()
    want, got = plain_links(nodes), {(r["a"], r["b"]): r["votes"] for r in im.image_links(nodes).collect()}
    assert len(want) > 700 and got.items() <= want.items()
    assert len(got) >= 0.99 * len(want)  # recall of the tables
    classes = {r["id"]: r["class_id"] for r in im.image_classes(spark.createDataFrame(rows, "media_id long, data binary")).collect()}
    assert classes == {i: i // 10 * 10 if i < 1000 else 1000 for i, _ in rows}


def test_a_descriptor_that_many_images_share_takes_no_votes(spark):
    r = np.random.default_rng(9)
    common = r.integers(0, 256, (5, 32)).astype(np.uint8)
    spots = [[10.0, 40.0, 20.0, 50.0, 30.0], [12.0, 15.0, 44.0, 48.0, 30.0]]
    rows = [(k, [5.0], [5.0], [0.0], [1.0], common[k - 1].tobytes()) for k in range(1, 6)]
    rows += [(k, *spots, [0.0] * 5, [1.0] * 5, common.tobytes()) for k in (6, 7)]
    nodes = spark.createDataFrame([(x[0] + 100, *x) for x in rows], "node long, id long, x array<float>, y array<float>, angle array<float>, scale array<float>, bits binary")
    assert [tuple(x) for x in im.image_links(nodes).collect()] == [(6, 7, 5)]
    assert plain_links(nodes) == {(6, 7): 5}


def test_large_pictures_have_more_corners(spark):
    r = np.random.default_rng(4)
    large = np.block([[im.draw(r.normal(size=64)) for _ in range(12)] for _ in range(12)])
    crop = np.clip(large[100:500, 80:480] * 0.9 + 20, 0, 255)
    rows = [(1, im.write_pgm(large), "k"), (2, im.write_pgm(crop), "k"), (3, im.write_pgm(np.rot90(large, 2)), "k")]
    got = im.image_classes(spark.createDataFrame(rows, "media_id long, data binary, key string")).collect()
    assert {x["class_id"] for x in got} == {1} and all(x["n_corners"] > 500 and x["n_links"] == 2 for x in got)


def test_descriptors_survive_turns_and_brightness():
    picture = im.draw(np.ones(64))
    one, turned = im.describe(picture[None]), im.describe(im.edited(picture, 2)[None])
    bits = [f[im.WORDS].to_numpy(np.int64).view(np.uint64) for f in (one, turned)]
    distance = np.bitwise_count(bits[0][:, None] ^ bits[1][None]).sum(axis=2)
    assert (distance.min(axis=1) <= im.MAX_DISTANCE).mean() > 0.7
    assert len(im.describe(np.zeros((2, 64, 64), np.uint8))) == 0 and len(im.describe(np.zeros((1, 9, 9), np.uint8))) == 0


def test_files():
    picture = im.draw(np.zeros(64))
    assert (im.read_pgm(im.write_pgm(picture)) == picture).all()
    assert im.read_pgm(b"P6\n2 1\n255\n" + bytes([255, 255, 255, 0, 0, 0])).tolist() == [[255, 0]]
    assert all(im.read_pgm(x) is None for x in (None, b"", b"P5", b"P5 9 9 255\nshort", b"PNG 1 1 255 x", b"P5 x 1 255 y", b"P5 1 1 65535 zz"))


def test_odd_rows(spark):
    good = im.write_pgm(im.draw(np.ones(64)))
    big = 2**60 + 1
    rows = [(big, good, "h"), (1, None, "a"), (2, None, "b"), (3, b"junk", "c"), (4, b"junk", "d"), (None, good, "e"), (7, good, "f"), (7, good, "f"), (9, good, "g")]
    docs = spark.createDataFrame(rows, "media_id long, data binary, key string")
    out = im.image_classes(docs).collect()
    got = sorted(((r["id"] or -1, r["class_id"]) for r in out), key=str)
    assert {r["id"]: r["n_copies"] for r in out} == {1: 1, 2: 1, 3: 2, 4: 2, None: 1, 7: 4, 9: 4, big: 4} and all(r["n_links"] == 0 for r in out)
    assert got == sorted([(big, 7), (1, 1), (2, 2), (3, 3), (4, 3), (-1, None), (7, 7), (7, 7), (9, 7)], key=str)
    assert im.image_classes(docs.limit(0)).count() == 0
