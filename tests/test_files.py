"""WAV files, containers, folders, the command line, streaming ingestion."""

import json
import os
import struct
import wave

import numpy as np
import pytest

from rangeweave import batch, cli
from rangeweave.operators import codec
from rangeweave.params import CodecParams
from rangeweave.sources import container, wav
from rangeweave.streaming import ingest

RNG = np.random.default_rng(7)


def write_wav(path, width, channels=1, n=200, rate=8000):
    top = {1: 127, 2: 32767, 3: 8388607, 4: 2**31 - 1}[width]
    x = (np.sin(np.arange(n * channels) / 5) * 0.5 * top).astype(np.int64)
    raw = b"".join(int(v).to_bytes(4, "little", signed=True)[:width] if width > 1 else bytes([int(v) + 128]) for v in x)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return x.reshape(-1, channels).mean(axis=1)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
@pytest.mark.parametrize("channels", [1, 2])
def test_widths_and_downmix(tmp_path, width, channels):
    want = write_wav(tmp_path / "a.wav", width, channels)
    head, got = wav.parse((tmp_path / "a.wav").read_bytes())
    assert head == {"framerate": 8000, "sampwidth": width, "n_channels": channels}
    assert np.allclose(got, want)


def test_written_files_read_back_and_limits_hold():
    x = np.array([-40000.0, -1.9, -0.5, 0.9, 1.9, 40000.0])
    assert wav.parse(wav.build(x, 8000, 2))[1].tolist() == [-32768, -1, 0, 0, 1, 32767]
    assert wav.parse(wav.build(x, 8000, 1))[1].tolist() == [-128, -2, -1, 0, 1, 127]
    assert wav.parse(wav.build(x, 8000, 3))[1].tolist() == [-40000, -1, 0, 0, 1, 40000]
    f = np.array([0.25, -0.5])
    assert wav.parse(wav.build(f, 8000, 4))[1].tolist() == f.tolist()
    assert wav.parse(wav.build(f, 8000, 4, legacy=True), legacy=True)[1].tolist() == f.tolist()


def test_bad_wavs_are_refused():
    good = wav.build(np.zeros(4), 8000, 2)
    with pytest.raises(ValueError, match="compressed"):
        wav.parse(good[:20] + struct.pack("<H", 6) + good[22:])
    with pytest.raises(ValueError, match="5 bytes"):
        wav.decode_pcm(b"12345", 5)
    with pytest.raises(ValueError, match="not a WAV"):
        wav.parse(b"hello")


def test_container_round_trip_and_errors():
    h = container.Header(4, 8000, 2, 32, 1, 0.5, 2, 3, 7)
    tiles = RNG.normal(size=(3, 4)).astype(np.float32)
    data = container.pack(h, tiles, np.array([(1, 0.5, 2.0, 1, np.inf), (-1, 0, 0, 0, 0)]))
    assert len(data) == 66 + 3 * 4 * 4 + 2 * 17
    head, t, m = container.unpack(data)
    assert head == h
    assert (t == tiles).all()
    assert m["dom"].tolist() == [1, -1]
    assert np.isinf(m["err"][0])
    for bad, what in ((b"XXXX" + data[4:], "magic"), (data[:4] + b"\x02" + data[5:], "version"), (data[:-1] + bytes([data[-1] ^ 1]), "checksum"), (data[:-1], "shorter"), (data[:10], "shorter")):
        with pytest.raises(ValueError, match=what):
            container.unpack(bad)
    assert container.unpack(data[:-1] + bytes([data[-1] ^ 1]), verify=False)
    head, t, m = container.unpack(container.pack(container.Header(4, 8000, 2, 32, 1, 0.5, 0, 0, 7), np.zeros((0, 4)), np.zeros((0, 5))))
    assert t.shape == (0, 4)
    assert len(m) == 0
    with pytest.raises(ValueError, match="65535"):
        container.pack(container.Header(4, 8000, 2, 70000, 1, 0.5, 0, 0, 7), tiles, np.zeros((0, 5)))


def test_folder_there_and_back(spark, tmp_path):
    source, coded, back = (tmp_path / n for n in ("in", "coded", "back"))
    source.mkdir()
    write_wav(source / "tone.WAV", 2)
    (source / "broken.wav").write_bytes(b"RIFFnothing")
    (source / "note.txt").write_text("x")
    with wave.open(str(source / "silent.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 100)
    p = CodecParams(tile=32, top_k=8, scale_mode="stored")
    rows = {os.path.basename(r["input"]): r for r in batch.compress(spark, str(source), str(coded), p).collect()}
    assert set(rows) == {"tone.WAV", "broken.wav", "silent.wav"}
    assert rows["broken.wav"]["error"]
    assert rows["tone.WAV"]["ratio"] > 0
    assert sorted(os.listdir(coded)) == ["silent.fwav", "tone.fwav"]
    assert {os.path.basename(r["input"]) for r in batch.compress(spark, str(source), str(coded), p).collect()} == {"broken.wav"}
    done = batch.decompress(spark, str(coded), str(back), p)
    assert done.where("error is null").count() == 2
    x, y = (wav.parse(f.read_bytes())[1] for f in (source / "tone.WAV", back / "tone.wav"))
    assert len(x) == len(y)
    assert 10 * np.log10((x**2).sum() / ((x - y) ** 2).sum()) > 12
    assert wav.parse((back / "silent.wav").read_bytes())[1].tolist() == [0] * 50
    batch.save_metrics(done, str(tmp_path / "m.json"))
    assert len(json.loads((tmp_path / "m.json").read_text())) == 2


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 0
    assert "compress" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["compress", "x.wav"])
    with pytest.raises(SystemExit):
        cli.main(["compress", "x.wav", "y", "--batch"])
    (tmp_path / "in").mkdir()
    write_wav(tmp_path / "in" / "a.wav", 2, n=80)
    assert cli.main(["compress", str(tmp_path / "in"), "--batch", "--tile", "32", "--out", str(tmp_path / "out")]) == 0
    assert (tmp_path / "out" / "a.fwav").exists()
    assert (tmp_path / "out" / "compression_metrics.json").exists()


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_wav(tmp_path / "in" / "a.wav", 2, n=80)
    p = CodecParams(tile=32, top_k=4)
    run = lambda: ingest.encode_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), p).awaitTermination()
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out" / "signals")).count() == 1
    write_wav(tmp_path / "in" / "b.wav", 2, n=80)
    run()
    got = spark.read.parquet(str(tmp_path / "out" / "matches"))
    assert got.select("sid").distinct().count() == 2
    assert got.count() == 2 * 20


def test_container_frames_survive_spark(spark, tmp_path):
    p = CodecParams(tile=32, top_k=4, mask=False)
    x = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(RNG.normal(0, 100, 70))], "sid string, i long, x double")
    _, d, m = codec.encode(x, p)
    signals = spark.createDataFrame([("a", 8000, 2, 70), ("none", 8000, 2, 5)], "sid string, framerate int, sampwidth int, n long")
    made = {r["sid"]: bytes(r["content"]) for r in container.contents(m, d, signals, p).collect()}
    h, tiles, got = container.unpack(made["a"])
    assert (h.n_ranges, h.n_domains, h.original_len) == (18, 39, 70)
    assert got["dom"].tolist() == [r["dom"] for r in m.orderBy("rid").collect()]
    assert container.unpack(made["none"])[0].n_ranges == 0


def folder_round_trip(spark, tmp_path, files, tiles):
    """SNR of every file after compression, each with its own tile, and one decompression of all."""
    source, coded, back = (tmp_path / n for n in ("in", "coded", "back"))
    for name, data in files.items():
        one = source / name.replace(".", "_")
        one.mkdir(parents=True)
        (one / name).write_bytes(data)
        batch.compress(spark, str(one), str(coded), CodecParams(tile=tiles[name], top_k=8, scale_mode="stored"))
    done = batch.decompress(spark, str(coded), str(back), CodecParams(scale_mode="stored"))
    assert done.where("error is not null").count() == 0
    out = {}
    for name, data in files.items():
        x = wav.parse(data, unit=True)[1]
        y = wav.parse((back / name).read_bytes(), unit=True)[1]
        assert len(x) == len(y)
        out[name] = 10 * np.log10((x**2).sum() / ((x - y) ** 2).sum())
    return out, done


def test_wide_samples_and_mixed_tiles_come_back(spark, tmp_path):
    t = np.sin(np.arange(400) / 5)
    write_wav(tmp_path / "whole.wav", 4, n=400)
    files = {
        "whole.wav": (tmp_path / "whole.wav").read_bytes(),
        "float.wav": wav.build(1.5 * t, 8000, 4),
        "small.wav": wav.build(9000 * t, 8000, 2),
        "large.wav": wav.build(9000 * t, 8000, 2),
    }
    got, _ = folder_round_trip(spark, tmp_path / "x", files, {"whole.wav": 32, "float.wav": 32, "small.wav": 32, "large.wav": 64})
    assert all(snr > 10 for snr in got.values()), got


def test_a_broken_container_is_an_error_row(spark, tmp_path):
    source, coded, back = (tmp_path / n for n in ("in", "coded", "back"))
    source.mkdir()
    write_wav(source / "a.wav", 2)
    write_wav(source / "a.WAV", 2, n=120)
    p = CodecParams(tile=32, top_k=8, scale_mode="stored")
    assert batch.compress(spark, str(source), str(coded), p).where("error is null").count() == 2
    assert sorted(os.listdir(coded)) == ["a.WAV.fwav", "a.wav.fwav"]
    bad = bytearray((coded / "a.wav.fwav").read_bytes())
    bad[-1] ^= 1
    (coded / "b.fwav").write_bytes(bytes(bad))
    (coded / "c.fwav").write_bytes(b"x")
    rows = {os.path.basename(r["input"]): r for r in batch.decompress(spark, str(coded), str(back), p).collect()}
    assert rows["b.fwav"]["error"] == "checksum mismatch"
    assert "shorter" in rows["c.fwav"]["error"]
    assert sorted(os.listdir(back)) == ["a.WAV.wav", "a.wav.wav"]
    assert rows["a.wav.fwav"]["error"] is None


def test_command_line_of_one_file(spark, tmp_path):
    write_wav(tmp_path / "a.wav", 2, n=80)
    assert cli.main(["compress", str(tmp_path / "a.wav"), str(tmp_path / "deep.bin"), "--tile", "32"]) == 0
    assert container.unpack((tmp_path / "deep.bin").read_bytes())[0].original_len == 80
