"""Labels of the usual forms in which licences are named, declared and granted."""

import pytest

from plumbline.llm import licenses

CASES = {
    "SPDX-License-Identifier: GPL-2.0-only": "gpl", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl", "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
    "// SPDX-License-Identifier: AGPL-3.0-only\n": "agpl", "SPDX-License-Identifier: GPL-2.0+": "gpl", "SPDX-License-Identifier: MIT OR Apache-2.0": "apache,mit",
    "SPDX-License-Identifier: (MIT AND BSD-3-Clause) OR MPL-2.0": "bsd-3-clause,mit,mpl", "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": "classpath-exception,gpl",
    "SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note": "gpl,linux-syscall-note", '"license": "ISC",': "isc", "license = \"Apache-2.0\"": "apache", "License: Zlib": "zlib",
    "GPLv3": "gpl", "licensed under the GPL v2": "gpl", "Apache-2.0": "apache", "Apache 2.0 license": "apache", "Redistributions of source code must retain": "bsd", "LGPLv2.1+": "lgpl",
    "released under the AGPL": "agpl", "BSD-3-Clause": "bsd-3-clause", "If a copy of the MPL was not distributed with this file": "mpl", "under the same terms as Perl itself": "",
    "This library may be licensed under the same terms as Perl itself": "artistic", "Proprietary and confidential": "all-rights-reserved", "CC-BY-SA-4.0": "cc-by,cc-by-sa",
    # what names a licence without granting it
    "it is not licensed under the MPL or Mozilla Public License": "", "a license plate and a driver's license": "", "isc, vim and ruby are words": "", "license: unknown": "",
    "http://joinup.ec.europa.eu/x\nMozilla Public License\nzlib license\nEclipse Public License\nArtistic License\neupl": "artistic,epl,mpl,zlib",
    "https://www.w3.org/consortium/legal/2015\nthe Mozilla Public License and other software": "mpl",
    "the ruby license": "ruby", "node v10 mit wasser": "",
}


@pytest.mark.parametrize("text", CASES)
def test_labels(text):
    assert licenses.scan(text.encode())[5] == CASES[text]


def test_rules():
    made = licenses.rules()
    assert len(made) > 300 and len({(r.label, r.pattern.pattern) for r in made}) == len(made)
    # every rule's pattern can only match where one of its keywords stands, declared identifiers aside
    assert all(k == k.lower() for r in made for k in r.keywords)


def test_long_texts_take_linear_time():
    assert licenses.scan(("license: " * 20000 + "mit").encode())[5] == ""
    assert licenses.scan(("neither the name of " * 5000).encode())[5] == ""
    assert licenses.scan(("( " * 20000 + "spdx-license-identifier: " + "( " * 20000).encode())[5] == ""
