"""Memory of the Python workers of the pipeline: two of them share an executor with its own memory."""

import subprocess
import sys

PACKING = """
import random, threading, time
import pyarrow as pa
import corpus_pipeline
from rfsense.llm import packing
from rfsense.llm.queries import WORD_BPE


class Here:  # hands out what a worker runs
    def mapInArrow(self, run, ddl):
        return run


packing.texts_of = lambda docs: Here()
run = packing.pieces(None, WORD_BPE, 2048)
rng = random.Random(1)


def batches():
    for at in range(0, 12 << 20, corpus_pipeline.BATCH_BYTES):
        texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(400)) for _ in range(corpus_pipeline.BATCH_BYTES // 3200)]
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})


def held():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


list(run(iter([next(batches())])))  # the tokenizer is loaded
began, most, done = held(), 0, False


def watch():
    global most
    while not done:
        most = max(most, held())
        time.sleep(0.003)


thread = threading.Thread(target=watch)
thread.start()
for _ in run(batches()):
    pass
done = True
thread.join()
print(most - began)
"""


def test_a_packing_worker_holds_little_beside_its_tokenizer():
    got = subprocess.run([sys.executable, "-c", PACKING], capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr
    assert float(got.stdout) < 120  # MB
