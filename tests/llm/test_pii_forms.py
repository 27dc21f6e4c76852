"""Personal data in forms that training never makes: recall by kind, and clean numbers left alone."""

from __future__ import annotations

import json
import random
from collections import defaultdict

from resalio.llm import pii

from .test_more import luhn_number
from .test_operators import WORDS


def test_forms_that_training_does_not_make(spark):
    rng = random.Random(11)
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    mail = lambda: f"{rng.choice(WORDS)}.{rng.choice(WORDS)}@{rng.choice(WORDS)}.example.{rng.choice(('com', 'org', 'net'))}"
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    make = (mail, ip, lambda: luhn_number(rng), phone)
    seen = [(k, f"{words(8)} {make[k % 4]()} {words(8)} {rng.randrange(10**15, 10**16)} {words(3)} {rng.randrange(10**6)}") for k in range(1600)]
    models = json.loads(pii.train(spark.createDataFrame(seen, "doc_id long, text string").repartition(3)))

    def unseen(kind):
        if kind == 0:
            local, domain = mail().split("@")
            return [local + at + domain.replace(".", dot) for at, dot in (("<at>", "<dot>"), ("[AT]", "[DOT]"), (" {at} ", " {dot} "), ("(@)", "."))]
        if kind == 1:
            parts = ip().split(".")
            return [s.join(parts) for s in ("/", " ", ":", " - ", ". ")]
        if kind == 2:
            n = luhn_number(rng)
            return [f"{n[:6]}-{n[6:10]}.{n[10:]}", ":".join(n[k : k + 4] for k in range(0, 16, 4)), n[:8] + "  " + n[8:], " . ".join(n[k : k + 2] for k in range(0, 16, 2))]
        d = str(rng.randrange(2, 10)) + "".join(str(rng.randrange(10)) for _ in range(9))
        return [f"({d[:3]}){d[3:6]}-{d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"00 1 {d[:3]} {d[3:]}"]

    hit, asked = defaultdict(int), defaultdict(int)
    for _ in range(60):
        for kind, name in enumerate(pii.KINDS):
            for new in unseen(kind):
                text = f"{words(6)} {new} {words(6)}"
                if not pii.base_spans(text):
                    at = text.index(new)
                    asked[name] += 1
                    hit[name] += (kind, at, at + len(new)) in pii.all_spans(text, [], models)
    recall = {k: hit[k] / asked[k] for k in asked}
    assert len(asked) == 4 and min(recall[k] for k in ("email", "ip", "phone")) >= 0.8 and recall["card"] >= 0.7, recall
    clean = [f"{words(5)} {rng.randrange(1, 28)}/{rng.randrange(1, 12)}/2024 {rng.randrange(24)}:{rng.randrange(60)} {words(3)} at noon {words(2)} dot {rng.randrange(10**5)} (at) {words(2)}" for _ in range(300)]
    assert sum(len(pii.all_spans(t, pii.base_spans(t), models)) for t in clean) <= 6
