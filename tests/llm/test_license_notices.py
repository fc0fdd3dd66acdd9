"""Notices as they are written: wrapped over lines, inside comments, with a word changed; and texts that only look like them."""

from larder.llm import licenses

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 * 1. Redistributions of source code must retain the above copyright notice."""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
FILL = " ".join(f"filler{i}" for i in range(200))


def test_wrapped_notices(spark):
    texts = {1: (MIT, "mit"), 2: (BSD, "bsd"), 3: (GPL, "gpl"), 4: (APACHE, "apache-2"), 5: (ISC, "isc")}
    rows = [(i, t) for i, (t, _) in texts.items()] + [(10 + i, t.replace("\n", " ")) for i, (t, _) in texts.items()]
    rows += [(20 + i, FILL + "\n" + t + "\n" + FILL * 3) for i, (t, _) in texts.items()] + [(31, MIT.replace("hereby", "herewith")), (40, FILL)]
    rows += [(41, "the license of this software is free of charge and any person may copy it"), (42, "released under the apache license"), (43, "this work is licensed under cc by sa 4.0")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (_, label) in texts.items():
        for n in (i, 10 + i, 20 + i):
            assert got[n].labels == label and got[n].score >= 0.8, (n, got[n])
    assert got[31].labels == "mit" and all(got[n].labels == "" for n in (40, 41, 42, 43))


def test_templates_fit_their_windows():
    assert all(2 * len(t.split()) <= licenses.width(t) for t in licenses.TEMPLATES.values())
