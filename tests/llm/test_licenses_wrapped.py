from marginalia.llm.licenses import scan_licenses

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
BSD = "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:"
GPL = " * you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by\n * the Free Software Foundation"


def test_wrapped_headers(spark):
    narrow = MIT.replace(" ", "\n")
    docs = [
        (1, f"A title\n\n{MIT}\nmore"), (2, f"prose before it\n{BSD}\nprose after it"), (3, GPL), (4, f"{MIT}\n\n{BSD}\n\n{GPL}"), (5, narrow), (6, "word " * 20_000 + "\n" + MIT),
        (7, MIT.replace("\n", "\n\n")), (8, "Permission is hereby granted, free of charge,\n\nto any person"), (9, "prose before it\nReleased under the MIT License.\nprose after it"),
    ]
    got = {}
    for r in scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if r.family != "unknown":
            got.setdefault(r.doc_id, []).append((r.line, r.family))
    assert {i: sorted(x) for i, x in got.items()} == {
        1: [(2, "MIT")], 2: [(1, "BSD")], 3: [(0, "GPL")], 4: [(0, "MIT"), (4, "BSD"), (8, "GPL")], 5: [(0, "MIT")], 6: [(1, "MIT")], 9: [(1, "MIT")],
    }


def test_one_row_for_each_wrapped_notice(spark):
    rows = scan_licenses(spark.createDataFrame([(1, MIT), (2, BSD), (3, GPL)], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.line, r.family) for r in rows if r.line == 0} == {(1, 0, "MIT"), (2, 0, "BSD"), (3, 0, "GPL")}
    assert all(r.paragraph.count("\n") > 0 and r.similarity > 0.9 for r in rows if r.line == 0)
