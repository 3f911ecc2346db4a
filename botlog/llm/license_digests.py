"""Digests of full licence texts for the licence lookup: (license_id, digest).

Each is the digest (``licenses.digest``) of a whole text as it is shipped with
packages, named in the comment; a licence has a row for every wording met, such
as the addresses of the FSF. A full text of the GPL family does not say "only"
or "or later", so neither do the ids. EPL, AGPL, CC-BY-4.0, CC-BY-NC-4.0 and
other licences whose texts were not at hand have no row.
"""

FULL: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "07175eee758cd668f241b9ebf2369e928f82242870029aba6cbef22e4d6e48c6"),  # miette-derive-7.6.0/LICENSE
    ("Apache-2.0", "23c0498e738b86da84fa1ffb1ff43f4ef103f365367077ada18cd1db1813d6da"),  # licenses/LICENSE
    ("Apache-2.0", "81e9b74a977a0320a7f1118705e033ed557f3f7d1e88cac937c574ad075941aa"),  # bytemuck-1.24.0/LICENSE-APACHE
    ("Apache-2.0", "98378616989e23431b15181388a001fdeac0999db741918e302c5162392bcfbd"),  # licenses/LICENSE.openssl-3.txt
    ("Apache-2.0", "caf2bd1e174c1bbcd0590cb3c0cb8a34ad0660bd96959d004c446df169c0e74a"),  # adler2-2.0.1/LICENSE-APACHE
    ("Apache-2.0", "d39104fea68387a9dd8918a8120f79489bf7c0e0aa54639fc0b220374279cb76"),  # rand_core-0.10.0/LICENSE-APACHE
    ("Apache-2.0", "ebc600199db9838b4fc2d5288a12598c2702142177a89b3443f5cc87b137d94b"),  # licenses/LICENSE_APACHE
    ("Artistic-1.0-Perl", "cc2cd6cccfacd5fb622fb0e9b9a373fa9dcb86a8c152213a2b856dfbe24fe304"),  # common-licenses/Artistic
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),  # xxhash-rust-0.8.15/LICENSE
    ("CC-BY-SA-4.0", "def99b23ba8930a02c111ffb99c0c4f55f9fd9bb38ad3ffe9df58fde3aac4247"),  # licenses/CC-BY-SA-4.0.txt
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),  # licenses/LICENSE-CC0.txt
    ("GFDL-1.2", "19d29a7c800a0d85704b63b4c09d5cd01dd9a287c61e238f4717d8a9e75d214f"),  # common-licenses/GFDL-1.2
    ("GFDL-1.3", "e70f40f3a50995855f972521fe4eaa4af360a4597e5914977b6093cce5243480"),  # common-licenses/GFDL
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),  # common-licenses/GPL-1
    ("GPL-2.0", "38854f914464ae348e584c4a28dea2f58d88db395ea40843a8bdb181bc890cad"),  # licenses/COPYING
    ("GPL-2.0", "5cb6370ac80145bff27a54858e51a973da8c42e030e5803cfe2c3953ae0150ac"),  # LICENSES/GPL-2.0-or-later.txt
    ("GPL-2.0", "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75"),  # licenses/GPL-2.0-only.txt
    ("GPL-2.0", "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1"),  # zstd/COPYING
    ("GPL-2.0", "e6a6b521df79eecdaa852ef89cab6ae3f9aa5aee3e1e26bfe41dfd4db36b4a76"),  # xz/COPYING.GPLv2
    ("GPL-3.0", "010ce52b3b970c80b5447205f4afc3b42084811cda2d11b95178b1fd3940764f"),  # licenses/COPYING
    ("GPL-3.0", "a94e2ff60e71a491e5db95941fe28139a74d19b3f5a8689c616670ada3c84164"),  # licenses/COPYING
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),  # licenses/GPL-3.0-or-later.txt
    ("LGPL-2.0", "450acd16c032a80434a46de9d2254179f898e426be6e7fa1ff362b7f866e30fc"),  # licenses/COPYING.LIB
    ("LGPL-2.0", "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3"),  # common-licenses/LGPL-2
    ("LGPL-2.1", "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345"),  # common-licenses/LGPL-2.1
    ("LGPL-2.1", "f6fe3336f20e299021dea9adac45d646a2deb88fbf8ea7f81588d7ee3a562c5f"),  # licenses/COPYING.LIB
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),  # licenses/LICENSE.txt
    ("MPL-1.1", "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),  # common-licenses/MPL-1.1
    ("MPL-2.0", "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),  # option-ext-0.2.0/LICENSE.txt
    ("OFL-1.1", "a4915a2dcd67c648b73ad8364858cba28bbfb700e62ca5847e2c30544066e01a"),  # licenses/OFL-1.1.txt
    ("Unicode-3.0", "c8872bc68de96ac9828c6f8d80528b3802f565f516a1c3319df506e3bc63409d"),  # finl_unicode-1.4.0/LICENSE-UNICODE
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),  # aho-corasick-1.1.4/UNLICENSE
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),  # bytemuck-1.24.0/LICENSE-ZLIB
    ("Zlib", "99618428d879198d4ae824db7ad07a9d0f9214f15429de52839cbe667713f21a"),  # random/LICENSE.txt
    ("Zlib", "b6548c47b5f6dcd55fa885fc443a69dc70c26d8370133a18f9f93d38f885c17a"),  # licenses/LICENSE.zlib.txt
)
