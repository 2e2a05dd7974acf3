"""Short forms of the notices by which licences are granted, lower case, in natural order.

Each is public text that authors are told to put into their files. Names, years and project titles,
which differ from file to file, are left out. Of notices that differ in few words every form is listed,
so that the exact one has the larger coefficient; no notice that goes on where another ends may equal it
there, so the clauses of BSD end with the first words of the disclaimer.
"""

TEMPLATES: dict[str, str] = {
    "MIT": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty
        of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software""",
    "MIT-line": "released under the mit license",
    "Apache-2.0": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable
        law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license""",
    "Apache-2.0-line": "licensed under the apache license version 2 0",
    "MIT-0": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so the software is provided as is without warranty of any kind express or implied including
        but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event
        shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract
        tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "Apache-1.0-line": "licensed under the apache license version 1 0",
    "Apache-1.1-line": "licensed under the apache license version 1 1",
    "BSD-2-Clause-line": "released under the bsd 2 clause license",
    "BSD-3-Clause-line": "released under the bsd 3 clause license",
    "BSD-line": "use of this source code is governed by a bsd style license that can be found in the license file",
    "ISC": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "0BSD": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        the software is provided as is and the author disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness""",
    "Zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
        any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
        including commercial applications and to alter it and redistribute it freely""",
    "BSL-1.0": """distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at
        http www boost org license 1 0 txt""",
    "EPL-1.0": """this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
        which accompanies this distribution and is available at http www eclipse org legal epl v10 html""",
    "EPL-2.0": """this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
        which is available at https www eclipse org legal epl 2 0""",
    "MPL-1.1": """the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file
        except in compliance with the license you may obtain a copy of the license at http www mozilla org mpl""",
    "MPL-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at https mozilla org mpl 2 0""",
    "CC0-1.0": """to the extent possible under law the person who associated cc0 with this work has waived all copyright and related
        or neighboring rights to this work""",
    "CC0-line": "licensed under cc0 1 0",
    "Unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
        or non commercial and by any means""",
}


def _bsd() -> dict[str, str]:
    clauses = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
        conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the
        following disclaimer in the documentation and or other materials provided with the distribution"""
    advertising = """all advertising materials mentioning features or use of this software must display the following acknowledgement
        this product includes software developed by"""
    names = """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission"""
    end = "this software is provided by the copyright holders and contributors as is"
    return {
        "BSD-2-Clause": f"{clauses} {end}",
        "BSD-3-Clause": f"{clauses} {names} {end}",
        "BSD-4-Clause": f"{clauses} {advertising} {names} {end}",
    }


def _gnu() -> dict[str, str]:
    """The notices of the GNU licences over a program or a library, for one version or later ones too, and their lines."""
    kinds = [("GPL", "general", ["1.0", "2.0", "3.0"]), ("LGPL", "library general", ["2.0"]), ("LGPL", "lesser general", ["2.1", "3.0"]), ("AGPL", "affero general", ["3.0"])]
    out = {}
    for name, kind, versions in kinds:
        for version in versions:
            number = version.removesuffix(".0").replace(".", " ")
            out[f"{name}-{version}-line"] = f"this work is licensed under the gnu {kind} public license version {number}"
            terms = {"only": f"version {number}", "or-later": f"either version {number} of the license or at your option any later version"}
            for form, which in terms.items():
                for noun in ("program", "library"):
                    usual = noun == ("library" if name == "LGPL" else "program")
                    out[f"{name}-{version}-{form}" + ("" if usual else f"-{noun}")] = f"""this {noun} is free software you can redistribute it
                        and or modify it under the terms of the gnu {kind} public license as published by the free software foundation
                        {which} this {noun} is distributed in the hope that it will be useful but without any warranty without even the
                        implied warranty of merchantability or fitness for a particular purpose see the gnu {kind} public license for
                        more details"""
    return out


def _creative_commons() -> dict[str, str]:
    """Long notices and lines of the six licences in five versions; a line without a version in its name is of 4.0."""
    words = {"by": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike"}
    out = {}
    for version, scope in (("4.0", "international"), ("3.0", "unported"), ("2.5", "generic"), ("2.0", "generic"), ("1.0", "generic")):
        number = version.replace(".", " ")
        for code in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd"):
            name = f"CC-{code.upper().replace(' ', '-')}"
            rights = " ".join(words[c] if c != "nd" or version == "4.0" else "noderivs" for c in code.split())
            out[f"{name}-{version}"] = f"""this work is licensed under the creative commons {rights} {number} {scope} license to view a copy
                of this license visit http creativecommons org licenses {code} {number}"""
            out[f"{name}-line" if version == "4.0" else f"{name}-{version}-line"] = f"licensed under cc {code} {number}"
    return out


TEMPLATES |= _bsd() | _gnu() | _creative_commons()
