"""The command line: files masked and restored through vault and sessions on disk."""

from veilframe.__main__ import main


def test_mask_and_restore(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("联系人：张三，电话：13812345678")
    (tmp_path / "b.json").write_text('{"mail": "x.y@example.com", "n": 1}')
    common = ["--vault", str(tmp_path / "vault"), "--project", "p"]
    main(["mask", str(tmp_path / "a.txt"), "--dry-run", *common])
    assert "张三" in capsys.readouterr().out and not (tmp_path / "a_masked.txt").exists()
    main(["mask", str(tmp_path / "a.txt"), str(tmp_path / "b.json"), *common])
    hidden = (tmp_path / "a_masked.txt").read_text()
    assert "张三" not in hidden and "13812345678" not in hidden and hidden.startswith("联系人：{{PERSON_")
    assert "x.y@" not in (tmp_path / "b_masked.json").read_text()
    main(["restore", str(tmp_path / "a_masked.txt"), *common])
    assert (tmp_path / "a_restored.txt").read_text() == (tmp_path / "a.txt").read_text()
    (tmp_path / "c.txt").write_text("张三 wrote")
    main(["mask", str(tmp_path / "c.txt"), *common])
    capsys.readouterr()
    main(["sessions", *common])
    main(["status", *common])
    shown = capsys.readouterr().out
    assert "completed" in shown and "mapping" in shown
