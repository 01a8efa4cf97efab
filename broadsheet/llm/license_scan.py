"""License scans: texts compared with license templates by the Dice coefficient over word bigrams.

Sentences, lines, paragraphs and the whole text are compared; of the near ties among what matches, the
larger template names the license. Words that tell licenses of a family apart must be the same in both, and what
several licenses share gives way to anything else. Dice of two sets is at least t only if neither is
over (2 - t) / t times the other's size, which leaves few templates for most units.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The clauses of the BSD licenses, which share most of their words.
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: The wording of public license notices, grants, warranty paragraphs and openings.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("GPL-3.0-or-later", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0-or-later", "Licensed under the GNU General Public License, version 3 or later."),
    ("GPL-3.0-or-later", "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("GPL-3.0-or-later", "The licenses for most software and other practical works are designed to take away your freedom to share and change the works. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. We, the Free Software Foundation, use the GNU General Public License for most of our software; it applies also to any other work released this way by its authors. You can apply it to your programs, too."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("BSD-2-Clause", _BSD_GRANT),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY}"),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", _BSD_NAMES),
    ("BSD-2-Clause", _BSD_WARRANTY),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("LGPL-3.0-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1-or-later", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1-only", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License version 2.1 as published by the Free Software Foundation."),
    ("LGPL-2.1-only", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0-or-later", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0-or-later", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("GPL-2.0-only", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users. This General Public License applies to most of the Free Software Foundation's software and to any other program whose authors commit to using it."),
    ("GPL-2.0-only", "Licensed under the GPL version 2."),
    ("GPL-3.0-only", "Licensed under the GPL version 3."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
#: Words that tell licenses of a family apart. A unit matches only templates with the same of them.
TELLING = ("affero", "lesser", "nc", "nd", "noderivatives", "noncommercial", "sa", "sharealike")
#: Texts that several licenses share; they name one only if nothing else in a text does.
SHARED = (_BSD_GRANT, _BSD_WARRANTY)

#: How far below the best Dice a larger template still names the license.
NEAR = 0.05
_RANK_OF_UNIT = lambda x: (-x[0], -x[1], x[2])
_TELLING = frozenset(w.encode() for w in TELLING)
_SENTENCE_END = re.compile(r"[.!?][ \t]+")
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz\n"
_TO_SPACE = bytes(b if b >= 128 or b in _KEPT else 32 for b in range(256))


def normalized(text: str) -> bytes:
    """Lower-cased in ASCII, each ASCII character but letters, digits and line ends made a space."""
    return text.encode().lower().translate(_TO_SPACE)


def bigrams(part: bytes) -> set[tuple[bytes, bytes]]:
    words = part.split()
    return set(zip(words, words[1:]))


def telling(part: bytes) -> frozenset[bytes]:
    """The words of a unit that tell licenses apart."""
    return frozenset(_TELLING.intersection(part.split()))


class Scanner:
    def __init__(self, templates=TEMPLATES, share: float = 0.8):
        made = ((bigrams(n), name, telling(n), t in SHARED) for name, t in templates for n in [normalized(t)])
        self.sets = sorted((x for x in made if x[0]), key=lambda x: (len(x[0]), x[1]))
        self.sizes, self.share, self.ratio = [len(x[0]) for x in self.sets], share, (2 - share) / share

    def unit(self, part: bytes) -> tuple[float, int, str, bool] | None:
        """(Dice, template's bigrams, license, whether it is shared) of the template nearest to the unit, if it matches;
        ties go to the larger template, then by name."""
        if len(part) < 2:
            return None
        own = bigrams(part)
        lo, hi = bisect_left(self.sizes, len(own) / self.ratio - 1e-9), bisect_right(self.sizes, len(own) * self.ratio + 1e-9)
        if lo >= hi or not own:
            return None
        tells = telling(part)
        scored = ((2 * len(own & s) / (len(own) + len(s)), len(s), name, shared) for s, name, words, shared in self.sets[lo:hi] if words == tells)
        return min((x for x in scored if x[0] >= self.share), key=_RANK_OF_UNIT, default=None)

    def text(self, text: str) -> tuple[str | None, float, int]:
        """(license, Dice, units that match) over sentences, lines, paragraphs and the text. Of the units'
        matches within NEAR of the best Dice the largest template wins, then the higher Dice, then the name;
        shared ones count only if there are no others."""
        plain = normalized(text)
        lines = plain.split(b"\n")
        units, block = [*lines], []
        for line in [*lines, b""]:
            if line.strip():
                block.append(line)
            else:
                if len(block) > 1:
                    units.append(b"\n".join(block))
                block = []
        if len(lines) > 1:
            units.append(plain)
        for line in text.split("\n"):
            sentences = _SENTENCE_END.split(line)
            if len(sentences) > 1:
                units += map(normalized, sentences)
        found = [x for x in map(self.unit, units) if x]
        if not found:
            return None, 0.0, 0
        kept = [x for x in found if not x[3]] or found
        top = max(x[0] for x in kept)
        dice, _, name, _ = min((x for x in kept if x[0] >= top - NEAR), key=lambda x: (-x[1], -x[0], x[2]))
        return name, dice, len(found)


def scan_licenses(text: Column, templates=TEMPLATES, share: float = 0.8) -> Column:
    """struct<license, dice, units> of a whole text: the best license (null if none has a Dice of
    ``share``), its Dice (else 0), and how many lines, sentences of lines of several, paragraphs (blocks of several
    lines) or texts of several lines match any. A null text counts as empty and matches none. Templates are a parameter
    of the call and few; templates of under two words never match."""
    scanner = Scanner(templates, share)

    @F.pandas_udf("license string, dice double, units int")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scanner.text(t) for t in texts], columns=["license", "dice", "units"])
        return out.astype({"license": object, "dice": "float64", "units": "int32"})

    return scan(F.coalesce(text, F.lit("")))
