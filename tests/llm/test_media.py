"""Telephony audio: exact round trips and reference decoders."""

import hashlib
import math
import zlib

import numpy as np
import pytest

from basalt.llm import media
from basalt.llm._text import shared_dir


def mulaw(u):
    u = ~u & 0xFF
    v = (((u & 15) << 3) + 0x84 << ((u >> 4) & 7)) - 0x84
    return -v if u & 0x80 else v


def alaw(a):
    a ^= 0x55
    v, seg = (a & 15) << 4, (a & 0x70) >> 4
    v = v + 8 if seg == 0 else v + 0x108 if seg == 1 else (v + 0x108) << (seg - 1)
    return v if a & 0x80 else -v


def adpcm(block):
    """One block, one sample at a time."""
    value, index, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            diff = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                diff += part if nibble & bit else 0
            value = max(-32768, min(32767, value - diff if nibble & 8 else value + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(value)
    return out


def test_tables():
    assert media.MULAW.tolist() == [mulaw(i) for i in range(256)]
    assert media.ALAW.tolist() == [alaw(i) for i in range(256)]


def test_adpcm_blocks_decode_together():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (9, 40), dtype=np.uint8)
    assert media.adpcm_decode(blocks).tolist() == [adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("codec", media.CODECS)
@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000])
def test_payload_is_read_back(codec, size):
    raw = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    payload = media.pad(raw)
    assert len(payload) % 576 == 0 and len(payload) > 0 and payload[:size] == raw and set(payload[size:]) <= {255}
    got, payloads, pcm = media.read_payloads([media.to_wav(codec, payload)])
    assert (got, payloads) == ([codec], [payload])
    assert len(pcm[0]) == len(payload) if codec != "adpcm" else len(pcm[0]) == len(payload) // 576 * 1153


def direct_resample(pcm, rate, to, zeros=8):
    """Every output by the filter's formula, one at a time, in whole numbers."""
    cut, out = min(1.0, to / rate), []
    half = math.ceil(zeros / cut)
    for n in range(-(-len(pcm) * to // rate)):
        at, part = divmod(n * rate, to)
        shape = []
        for i in range(1 - half, half + 1):
            x = i - part / to
            sinc = math.sin(math.pi * x * cut) / (math.pi * x * cut) if x else 1.0
            shape.append(sinc * (0.5 + 0.5 * math.cos(math.pi * x / half)) if abs(x) < half else 0.0)
        taps = [round(w / sum(shape) * 32768) for w in shape]
        taps[taps.index(max(taps))] += 32768 - sum(taps)
        total = sum(w * int(pcm[min(max(at + 1 - half + k, 0), len(pcm) - 1)]) for k, w in enumerate(taps))
        out.append(max(-32768, min(32767, (2 * total + 32768) // 65536)))
    return np.array(out)


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (8000, 11025), (8000, 6000), (16000, 8000), (44100, 8000), (8000, 8000)])
@pytest.mark.parametrize("size", [1, 2, 50, 400])
def test_resampling_at_any_ratio(rate, to, size):
    pcm = np.random.default_rng(size).integers(-30000, 30000, size).astype(np.int16)
    got = media.resample(pcm, rate, to)
    assert got.dtype == np.int16 and got.tolist() == direct_resample(pcm, rate, to).tolist()


def test_resampling_filters():
    """A tone that both rates hold stays; one that the lower rate cannot hold goes."""
    t = np.arange(8000)
    low = (8000 * np.sin(2 * np.pi * 500 / 8000 * t)).astype(np.int16)
    up = media.resample(low, 8000, 16000)
    assert abs(up[200:-200] - 8000 * np.sin(2 * np.pi * 500 / 16000 * np.arange(16000))[200:-200]).max() < 60
    assert (up[::2] == low).all()
    high = (8000 * np.sin(2 * np.pi * 3500 / 8000 * t)).astype(np.int16)
    assert abs(media.resample(high, 8000, 4000)[100:-100]).max() < 200
    assert len(media.resample(np.zeros(0, np.int16))) == 0


def by_hand(payload, wav):
    """Feature of a payload, from the codec's reference decoder and the direct filter."""
    kind = int.from_bytes(wav[20:22], "little")
    if kind == 17:
        pcm = [x for i in range(0, len(payload), 576) for x in adpcm(b"\0\0\0\0" + payload[i : i + 576])]
    else:
        pcm = [(mulaw if kind == 7 else alaw)(b) for b in payload]
    pcm = direct_resample(pcm, 8000, 16000).tolist()
    rms = (sum(x * x for x in pcm) / len(pcm)) ** 0.5
    crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
    return {6: "alaw", 7: "mulaw", 17: "adpcm"}[kind] + f";n={len(pcm)};rms={rms:.3f};zc={crossings};peak={max(map(abs, pcm))}"


def test_columns(spark, odd_docs, odd_texts, no_docs):
    place = shared_dir(spark, "media-test")
    kept = media.store(media.media_column(odd_docs), place)
    got = {r.doc_id: r for r in media.digests(kept).collect()}
    stored = {r.doc_id: r for r in media.store(media.with_pcm(kept), f"{place}-pcm").collect()}
    for i, t in enumerate(odd_texts):
        payload = media.pad((t or "").encode())
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-32:])
        assert (r.media_bytes, r.media_sha256) == (len(stored[i].media), hashlib.sha256(stored[i].media).hexdigest())
        assert r.pcm_sha256 == hashlib.sha256(stored[i].pcm).hexdigest()
        if len(payload) < 2000:
            assert r.feature == by_hand(payload, stored[i].media)
    assert got[0].feature == got[1].feature  # null and empty texts are equal
    assert media.digests(media.media_column(no_docs)).count() == media.with_pcm(media.media_column(no_docs)).count() == 0
    with pytest.raises(ValueError):
        media.from_wav(b"OggS")


def test_samples_are_stored_in_little_room(spark, tmp_path):
    """Rows of one codec lie together and take less room than by default settings; none is lost or changed."""
    words = ["".join(w) for w in np.random.default_rng(1).choice(list("etaoinshr"), (300, 6))]
    texts = [" ".join(np.random.default_rng(i).choice(words, 80)) for i in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows = media.decoded(media.store(media.media_column(docs), f"file://{tmp_path}/files"))
    rows.write.option("compression", "zstd").option("parquet.block.row.count.limit", media.PCM_ROWS).parquet(f"file://{tmp_path}/default")
    kept = media.store(rows, f"file://{tmp_path}/kept").collect()
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.parquet")) for k in ("default", "kept")}
    assert size["kept"] < 0.9 * size["default"]
    codecs = [r.codec for r in kept]
    assert set(codecs) == set(media.CODECS) and sum(a != b for a, b in zip(codecs, codecs[1:])) == 2
    assert sorted(r.doc_id for r in kept) == list(range(len(texts)))
    for r in kept[::50]:
        codec, _, pcm = media.read_payloads([media.stored(texts[r.doc_id].encode())])
        assert (r.codec, bytes(r.pcm)) == (codec[0], media.resample(pcm[0]).astype("<i2").tobytes())


def test_query_reads_stored_samples(spark, monkeypatch, tmp_path):
    """op4_media stores the resampled samples and takes its features from what it reads back."""
    pytest.importorskip("public_tokenizers")
    from pyarrow import parquet
    from pyspark.sql import functions as F

    from basalt.llm import queries

    texts = [(1, "one text"), (2, None), (3, ""), (None, "é" * 400), *((i, f"text {i}") for i in range(4, 304))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    monkeypatch.setattr(queries, "shared_dir", lambda _, name: f"file://{tmp_path}/{name}")
    rows = queries.op4_media(spark, "")
    got = {r.payload_sha256: r for r in rows.collect()}
    assert rows.count() == len(texts) and len(got) == len(texts) - 1  # null and empty texts are equal
    wavs = [bytes(r.media) for r in spark.read.parquet(f"file://{tmp_path}/media").collect()]
    kept = {r.payload_sha256: bytes(r.pcm) for r in spark.read.parquet(f"file://{tmp_path}/media-pcm").collect()}
    for wav, payload, samples in zip(wavs, *media.read_payloads(wavs)[1:]):
        sha = hashlib.sha256(payload).hexdigest()
        assert kept[sha] == media.resample(samples).astype("<i2").tobytes()
        assert got[sha].pcm_sha256 == hashlib.sha256(kept[sha]).hexdigest()
    for _, t in texts[:4]:
        payload = media.pad((t or "").encode())
        wav = next(w for w, p in zip(wavs, media.read_payloads(wavs)[1]) if p == payload)
        assert got[hashlib.sha256(payload).hexdigest()].feature == by_hand(payload, wav)
    groups = [parquet.ParquetFile(f).metadata for f in (tmp_path / "media-pcm").glob("*.parquet")]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) == media.PCM_ROWS

    real = media.store
    swap = lambda x, folder: real(x.withColumn("pcm", F.lit(b"\1\0")) if "pcm" in x.columns else x, f"{folder}-swapped")
    monkeypatch.setattr(media, "store", swap)
    assert {r.feature.split(";", 1)[1] for r in queries.op4_media(spark, "").collect()} == {"n=1;rms=1.000;zc=0;peak=1"}
