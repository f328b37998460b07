"""Signatures, certificates, content hashes and lineage."""

import json

import pytest

from fidelis import cli
from fidelis.functions import ed25519
from fidelis.model import Recording, Tolerances
from fidelis.plans import certificate, config, engine, report

# Secret, public, message and signature of RFC 8032, 7.1.
VECTORS = (
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
)


@pytest.mark.parametrize(("secret", "public", "message", "signature"), VECTORS)
def test_signatures(secret, public, message, signature):
    secret, public, message, signature = map(bytes.fromhex, (secret, public, message, signature))
    assert ed25519.public(secret) == public and ed25519.sign(secret, message) == signature
    assert ed25519.verify(public, message, signature)
    assert not ed25519.verify(public, message + b"x", signature)
    assert not ed25519.verify(public, message, signature[:32] + (int.from_bytes(signature[32:], "little") + ed25519.ORDER).to_bytes(32, "little"))
    assert not ed25519.verify(bytes([1]) + bytes(31), message, bytes([1]) + bytes(63))  # points of small order
    assert not ed25519.verify(public, message, signature[:40])


def recording(spark, shuffled=False, value="x", zero=0.0):
    rec = Recording(spark, "toy", "table")
    frames = [(e, 0, k, 1000 * k, f"{value}{k}") for e in range(3) for k in range(10)]
    rec.put("frames", spark.createDataFrame(frames[::-1] if shuffled else frames, "ep_ord long, st_ord long, frame_idx long, ts long, content_hash string").repartition(5 if shuffled else 1))
    rec.put("episodes", spark.createDataFrame([(e, e) for e in range(3)], "ep_ord long, episode long"))
    rec.put("streams", spark.createDataFrame([(e, 0, "a", "scalar-state", "c", "measured", (zero, 1.0, float("nan"), 0.5)) for e in range(3)], "ep_ord long, st_ord long, name string, modality string, clock_id string, clock_kind string, stats struct<min:double,max:double,mean:double,std:double>"))
    rec.put("provenance", spark.createDataFrame([("dataset", None, 0, "license", "MIT", "known"), ("episode", 1, 1, "upstream", "raw file/ä", "known"), ("dataset", None, 0, "annotator", "A B", "asserted"), ("dataset", None, 0, "sensor", "n/a", "known")], "scope_kind string, scope_episode long, record_id long, key string, value string, class string"))
    return rec


def test_content_hash(spark):
    one = certificate.content_hash(recording(spark))
    assert one == certificate.content_hash(recording(spark, shuffled=True)) == certificate.content_hash(recording(spark, zero=-0.0))
    assert len({one, certificate.content_hash(recording(spark, value="y")), certificate.content_hash(recording(spark, zero=0.1))}) == 3


def test_certificates(spark):
    rec, c = recording(spark), config.parse('only_checks = ["temporal.jitter"]\n[tolerances]\ngap_factor = 9')
    v, secret, public = engine.run(rec, c), VECTORS[0][0], VECTORS[0][1]
    signed = certificate.sign(certificate.build(v, c, "ab" * 32, public, "2030-01-01T00:00:00+00:00", engine.readiness(rec, v)), secret)
    signed = json.loads(json.dumps(signed))
    assert certificate.verify(signed, "ab" * 32, public.upper()) == {"key_id": public, "timestamp": "2030-01-01T00:00:00+00:00"}
    text = certificate.verified_text(signed, False, True)
    assert "issuer is not verified" in text and "only = temporal.jitter" in text and "gap_factor = 9" in text and "structural" in text and "does not apply" in text
    assert json.loads(certificate.verified_json(signed, True, True))["verified"]
    altered = json.loads(json.dumps(signed))
    altered["certificate"]["score"]["score"] = 100
    for bad, why, args in (
        (altered, "altered", {}), (signed, "bound to", {"content": "cd" * 32}), (signed, "not the issuer's", {"issuer": VECTORS[1][1]}), (signed, "secret key", {"issuer": secret}),
        (signed | {"algorithm": "rsa"}, "algorithm", {}), (signed | {"signature": signed["signature"].upper()}, "lower-case", {}), (signed | {"public_key": "00"}, "public key", {}), ({}, "no signed", {}),
        (signed | {"certificate": signed["certificate"] | {"schema": "x/2"}}, "schema", {}),
    ):
        with pytest.raises(certificate.CertificateError, match=why):
            certificate.verify(bad, **args)
    rec.coverage = "sample"
    with pytest.raises(certificate.CertificateError, match="sample"):
        certificate.certifiable(engine.run(rec, c))
    with pytest.raises(certificate.CertificateError):
        certificate.key_of("12")


def test_readiness_needs_one_whole_rig(spark):
    rec = Recording(spark, "rig", "table")
    kinds = ["point-cloud", "imu", "gnss"]
    rec.put("streams", spark.createDataFrame([(0, k, m, m) for k, m in enumerate(kinds)], "ep_ord long, st_ord long, name string, modality string"))
    rec.put("episodes", spark.createDataFrame([(0, 0), (1, 1)], "ep_ord long, episode long"))
    v = engine.Verdict("rig", "full", "pass", {}, (), engine.PROFILE, {}, "", 0)
    for ep, want in ((1, False), (0, True)):  # poses of another episode are none of this rig's
        rec.put("ego_poses", spark.createDataFrame([(ep, 0, 0, 0.0, 0.0, 0.0)], "ep_ord long, idx long, ts long, x double, y double, z double"))
        assert engine.readiness(rec, v)["ready"] is want
    assert Tolerances().loosened() == []


def test_prov(spark):
    g = {n["@id"]: n for n in report.w3c_prov(recording(spark))["@graph"]}
    assert set(g) == {"urn:dataset:toy", "urn:dataset:toy/episode/1", "urn:agent:A%20B"}
    assert g["urn:dataset:toy/episode/1"]["prov:wasDerivedFrom"] == [{"@id": "urn:dataset:toy"}, {"@id": "urn:source:raw%20file%2F%C3%A4"}]
    assert g["urn:dataset:toy"]["fidelis:element"] == [{"key": "license", "value": "MIT", "class": "known"}]


def test_keys_and_verification_by_command(spark, tmp_path, capsys):
    path = str(tmp_path / "key")
    assert cli.main(["keygen", path]) == 0 and cli.main(["keygen", path]) == 2  # a key is never written over
    secret, public = (open(p).read().strip() for p in (path, path + ".pub"))
    v = engine.Verdict("toy", "full", "pass", {"info": 0}, (), (), {}, "d", 0)
    signed = certificate.sign(certificate.build(v, engine.RunConfig(), "00" * 32, public, "now"), secret)
    (tmp_path / "c.json").write_text(json.dumps(signed))
    assert cli.main(["verify", str(tmp_path / "c.json"), "--key", path + ".pub"]) == 0 and "certificate verified" in capsys.readouterr().out
    assert cli.main(["verify", str(tmp_path / "c.json"), "--key", secret]) == 2 and "secret key" in capsys.readouterr().err
