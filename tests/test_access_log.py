"""Access logs by their line format."""

from vigilog.sources.access_log import read_access_log

TIME = "[01/Nov/2019:10:00:00 +0000]"


def test_lines(spark, tmp_path):
    path = tmp_path / "a.log"
    path.write_text("\n".join([
        f'- - {TIME} "GET /a?b=1 HTTP/1.1" 200 - "ref" s1 "agent x"',
        f'- - {TIME} "" 400 12 "-" s2 "-"',
        f'- - {TIME} "GET / HTTP/1.1" 200 5 "-" - "agent"',
        "noise", "",
    ]))
    rows = sorted(map(tuple, read_access_log(spark, str(path)).collect()), key=lambda r: r[6])
    stamp = TIME[1:-1]
    assert rows == [(stamp, "GET", "/a?b=1", "200", "", "ref", "s1", "agent x"), (stamp, "", "", "400", "12", "-", "s2", "-")]
