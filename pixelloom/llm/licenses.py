"""Known licence sentences, the rules over them, and the identifiers of licence expressions: fixed values."""

#: Sentences by identifier. "..." at the end: the sentence may go on; in the middle: words in between. What tells licences apart is part of them.
SENTENCES = {
    "mit-ref": "released under the MIT license",
    "apache2-ref": "licensed under the Apache License, Version 2.0",
    "gpl3-ref": "this work is licensed under the GNU General Public License version 3",
    "ccbync4-ref": "licensed under CC BY-NC 4.0",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy ...",
    "mit-notice": "The above copyright notice and this permission notice ...",
    "mit-as-is": 'The software is provided "as is", without warranty ...',
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy ...",
    "bsl-notices": "The copyright notices in the Software and this entire statement ...",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this ... is hereby granted, provided that ...",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": 'The software is provided "as is" and the ...',
    "apache2-header": "Licensed under the Apache License, Version 2.0 (the ...",
    "apache2-copy": "You may obtain a copy of the License ...",
    "apache2-terms": "Terms and conditions for use, reproduction, and distribution",
    "apache2-license": '"License" shall mean the terms and conditions for ...',
    "apache2-licensor": '"Licensor" shall mean the copyright owner or entity ...',
    "bsd-conditions": "Redistribution and use in source and binary forms ...",
    "bsd-source": "Redistributions of source code must retain the above ...",
    "bsd-binary": "Redistributions in binary form must reproduce the above ...",
    "bsd-advertising": "All advertising materials mentioning features or use of this software ...",
    "bsd-names": "Neither the name of ...",
    "bsd-as-is": "This software is provided by ...",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty ...",
    "zlib-liable": "In no event will the authors be held liable for any damages arising ...",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose ...",
    "gpl2-free": "This program is free software; you can redistribute ... under the terms of the GNU General Public License as published ... either version 2 of the License ...",
    "gpl3-free": "This program is free software: you can redistribute ... under the terms of the GNU General Public License as published ... either version 3 of the License ...",
    "agpl3-free": "This program is free software: you can redistribute ... under the terms of the GNU Affero General Public License as published ... either version 3 of the License ...",
    "lgpl3-free": "This program is free software: you can redistribute ... under the terms of the GNU Lesser General Public License as published ... either version 3 of the License ...",
    "lgpl21-free": "This library is free software; you can redistribute ... under the terms of the GNU Lesser General Public License as published ... either version 2.1 of the License ...",
    "gpl-useful": "This program is distributed in the hope that ...",
    "lgpl-useful": "This library is distributed in the hope that ...",
    "gpl-verbatim": "Everyone is permitted to copy and distribute verbatim ...",
    "lgpl21-first": "This is the first released version of the Lesser GPL",
    "lgpl21-successor": "It also counts as the successor of the GNU Library Public License ...",
    "gpl3-is": "The GNU General Public License is a free, copyleft license ...",
    "agpl3-is": "The GNU Affero General Public License is a free, copyleft license ...",
    "lgpl3-version": "This version of the GNU Lesser General Public License incorporates the terms ...",
    "gpl2-freedom": "The licenses for most software are designed to ...",
    "gpl3-freedom": "The licenses for most software and other practical ...",
    "mpl2-form": "This Source Code Form is subject to the ... Mozilla Public License v. 2.0 ...",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 ...",
    "busl-grant": "The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use ...",
    "unlicense": "This is free and unencumbered software released into ...",
}

#: Sentences that are also found inside longer ones.
REFERENCES = ["mit-ref", "apache2-ref", "gpl3-ref", "ccbync4-ref"]

#: Words that, up to three words before such a sentence, make it say the opposite.
NEGATIONS = ["not", "never", "no longer", "neither", "nor", "isn t", "aren t", "wasn t", "weren t", "cannot", "can t", "without being"]

#: Ordered rules, each a licence and the identifiers that must follow each other in a document, no other known sentence in between.
RULES = [
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache2-ref"]),
    ("GPL-3.0", ["gpl3-ref"]),
    ("CC-BY-NC-4.0", ["ccbync4-ref"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("BSL-1.0", ["bsl-grant", "bsl-notices", "mit-as-is"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("Apache-2.0", ["apache2-header", "apache2-copy"]),
    ("Apache-2.0", ["apache2-terms", "apache2-license", "apache2-licensor"]),
    ("BSD-4-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names", "bsd-as-is"]),
    ("BSD-3-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-names", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-conditions", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
    ("GPL-2.0", ["gpl2-free", "gpl-useful"]),
    ("GPL-3.0", ["gpl3-free", "gpl-useful"]),
    ("AGPL-3.0", ["agpl3-free", "gpl-useful"]),
    ("LGPL-3.0", ["lgpl3-free", "gpl-useful"]),
    ("LGPL-2.1", ["lgpl21-free", "lgpl-useful"]),
    ("GPL-2.0", ["gpl-verbatim", "gpl2-freedom"]),
    ("GPL-3.0", ["gpl-verbatim", "gpl3-freedom"]),
    ("GPL-3.0", ["gpl-verbatim", "gpl3-is", "gpl3-freedom"]),
    ("AGPL-3.0", ["gpl-verbatim", "agpl3-is", "gpl3-freedom"]),
    ("LGPL-2.1", ["gpl-verbatim", "lgpl21-first", "lgpl21-successor", "gpl2-freedom"]),
    ("LGPL-3.0", ["gpl-verbatim", "lgpl3-version"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("EPL-2.0", ["epl2-terms"]),
    ("BUSL-1.1", ["busl-grant"]),
    ("Unlicense", ["unlicense"]),
]

#: Identifiers that a licence expression may name; "-only", "-or-later" and "+" after them tell versions and are left off.
IDENTIFIERS = [
    "0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0",
    "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]
