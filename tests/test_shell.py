import pytest

from tallyforge import __main__ as shell
from tallyforge.sources import config, pages


def test_mail_settings():
    full = {"MAIL_CLIENT_ID": "c", "MAIL_CLIENT_SECRET": "s", "MAIL_REFRESH_TOKEN": "r", "MAIL_LABEL": "bills"}
    assert config.mail_settings({}.get) is None
    assert config.mail_settings(full.get).poll_seconds == 1800 and config.mail_settings((full | {"MAIL_POLL_SECONDS": "60"}).get).poll_seconds == 60
    for name in ("MAIL_CLIENT_SECRET", "MAIL_LABEL"):
        with pytest.raises(config.MissingSetting, match=name):
            config.mail_settings({k: v for k, v in full.items() if k != name}.get)
    for bad in ("0", "x", "-1"):
        with pytest.raises(config.MissingSetting):
            config.mail_settings((full | {"MAIL_POLL_SECONDS": bad}).get)


def test_model_settings():
    assert config.model_settings({}.get) is None
    local = config.model_settings({"MODEL_PROVIDER": "ollama", "MODEL_NAME": "m"}.get)
    assert local.key is None and local.base_url == "http://localhost:11434"
    keyed = config.model_settings({"MODEL_PROVIDER": "openai", "MODEL_NAME": "m", "OPENAI_API_KEY": "hidden", "OPENAI_BASE_URL": "http://x/"}.get)
    assert keyed.base_url == "http://x" and "hidden" not in repr(keyed)
    for bad in ({"MODEL_PROVIDER": "ollama"}, {"MODEL_PROVIDER": "x", "MODEL_NAME": "m"}, {"MODEL_PROVIDER": "openai", "MODEL_NAME": "m"}):
        with pytest.raises(config.MissingSetting):
            config.model_settings(bad.get)


def test_pages(tmp_path):
    fake = tmp_path / "draw"
    fake.write_text("#!/bin/sh\nfor n in 01 02 10; do printf $n > out-$n.png; done\n")
    fake.chmod(0o755)
    assert pages.rasterize(b"x", 4, str(fake)) == [b"01", b"02", b"10"]
    fake.write_text("#!/bin/sh\nexit 3\n")
    for program in (str(fake), str(tmp_path / "none"), "/bin/true"):
        with pytest.raises(pages.NoPages):
            pages.rasterize(b"x", 4, program)


def test_arguments():
    args = shell.arguments(["ingest", "mails", "--table", "t", "--reextract"])
    assert (args.command, args.mails, args.table, args.reextract) == ("ingest", "mails", "t", True)
    for bad in ([], ["ingest"], ["list"], ["list", "--table", "t", "--size", "x"]):
        with pytest.raises(SystemExit) as e:
            shell.arguments(bad)
        assert e.value.code == 2
