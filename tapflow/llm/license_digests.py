"""SHA-256 of the flowed forms (`licenses.flowed`) of complete license texts.

Made from the published files as they are, on one line, with one line for each
paragraph, and with paragraphs wrapped at each width from 60 to 100. Texts that
name their own publisher in copyright lines have several digests, since where a
statement ends depends on its line. To be made anew if the form changes."""

FULL_DIGESTS = {
    "Apache-2.0": [
        "58696a267f23583da563f701f231a342003df56974e100bb0a88c6dd2f0e5549",
    ],
    "BSD-2-Clause": [
        "1e90efbde571c0119dc41ae2d81e3e1a4daddca556e30f9f0ef1289efc8b5887",
    ],
    "BSD-3-Clause": [
        "0219e78112a256339982c0e3a874981f8f04d1445e4cf205a7a8489f059b072e",
        "1839c94209d91a4a7028378b502a6bef538982471f89fcd7211b960697601b8b",
        "3a4fe1b6a578459693d7576de37c7b909a966414b99da2438f468e981d6bcbd2",
        "a16cc9ff3c4521bcece96cff26581890d2447fa1f8b52f36f7852f34f870204d",
        "e8daa50c96df2ade9d116da144a66a3e46944a78c9ae7c49064074817a5d8988",
    ],
    "CC-BY-SA-4.0": [
        "264a94202bb93bf9eb41e82e97c281c74e7e9a0c74f3a94280d85f4ae535bd86",
    ],
    "CC0-1.0": [
        "b096badc0168abbd7a6496f3097d3b3e33b5d3d54dbc0990a1eb8341c549c075",
    ],
    "GPL-2.0": [
        "071d52f423bde074fca0e270abc4bb43aec1d4f0f8091aa431f58bb177405a06",
        "1e3221bcbe02bb0de379d8580481617b4530d68ef980ee29d827234c0c41a1c9",
        "1e47e92bdf3950d204e704a2c8c792f3aa32cbf97b9038bc2b228c0fd2ae286d",
        "21c3b4334c78f65e034340f36b423601f71a2e89b0e038d3fde8850aebfc1534",
        "2a5bf074fdf558533b4f0d24225c9037a2dbfd5f2fc1f4026010f1729bc807f1",
        "4f193f01044462ce366825712654bda3a8de8a9dce08c67a3069ea1359091cf1",
        "612176fc776b867b39bec6e7c99f8b69e4799e125ec0187a2129d4b4574c97e5",
        "6317a834fcf540b58e7cc3bf05c6f602fe2407b1dddcf63686dfbd9990932c4b",
        "66cc4f4a478abf0f79692a361b83c3471b619cfb3b82cde2041c798f2343a6bc",
        "67c85123c328e0713c014d7572ab61dd64ac4486871f03ca22f2f123558e8f5d",
        "6848ce091546269412e7fac9c5f74979e9b3c03b519a8c99208af4b8612681b7",
        "6930035a8bf575429f5f46508b5ef9d8d8bc0e19323288950cf72e687c9dbf16",
        "6b02609fc51be687d6e372a246ec06ded88677f8e267b4769592a21e631acf6e",
        "8b92c2bb98f4d5106802b9bc96d632f0e91ae3671f679441a1986a9e175c1632",
        "9cb60ecf26db9cee28248b8b884f2626bd733aaa4e13e545ee04fb2b6552cdaf",
        "9d27b80797a1a24542396ac49289a855bf00719eb742312b5f93483a962d64fd",
        "a3e0ea5c4227bc44eeab396c62f5a16934e4d23f37bf13fc12ec92340d8fe6bb",
        "b0945cae3c6fdfdaa1428a8899e27ec1977bf77edadbd05c48251d37505d1a8d",
        "bf351c5ce05db854b9e18bbf772e286535b1f2905373e48641d5465309802ed1",
        "d0853a75769f3f7e04542295cd0624ff691bf8c9ecba730e6913fb3002893fae",
        "d4db77037e34cc091ec02d5ea10e2f92ae9c41f0846ec52dd1e85b0feb74d44e",
        "e1458b007e841f18765c4fd80fd88ae821f3a7929e29ff1254939b8f8541411d",
        "f7b981db06073e4d4bc75ef7fd949074c1f192cc77462ce7d536e287d53ecc5d",
        "fa1429d2d463f73fc16dae22a3c2a678ffaa93c60c3fa9f289bed1a3fad8cb8e",
        "ff3fd7758fbf2a3c0ebcbcadd1cfbee710a095cb4c3ea685d01d1ae5bdbcf545",
    ],
    "GPL-3.0": [
        "051f1086f32c9ecc1de1fe3fa66bad2c3aa750d93e4daee571c620c15cdffb20",
        "059e4cb9c4753a8045f07e391533f3fa2d15b74b3698d0e537e60e3e809d75bf",
        "1db519830f1c39f54255a1298703d105236c6a8fd64ac47872fb2037697111e5",
        "2183509f36ab654915f6acc05419f7860a0eb4525ca02663db16ac9a2b9f25aa",
        "31e1dc9aa119a24fa13a871aa0c98424524c281b080bfe81aadc5be011459874",
        "40a520747ec5139e123eb7ee4ce8eac9951366fbbf1407ed3286fc3386222371",
        "5f3dcd3eca67e3b40edfbf1f16da4d703da640cddcf5a9667a99b088b26b9778",
        "63749e573950c9ad85e8b604bd8304a33aad8562a9830943967d47f4ecc18539",
        "8671923347c40f33a46b82939af77c6c1c915a551f3e38bd8af9a9cac46d6518",
        "8e41cf048777d7fee976b6270b7e00f38cc4469ee8fc0f0fc23698679c947f85",
        "dc277eefb1414c6056eaf53286441cfabce988b23337a9741621f5bae3aa6178",
        "f39f8e15ccc57411e4509237c34ea3bb67333ef987d0af8dbe3e793b1deab611",
    ],
    "LGPL-2.1": [
        "32e8dfadb9bad3603edb5413bf5fdb0681f51fb6bbeaf45f748d282d3c529a46",
        "45cb6aef6badbb59581eef5cc45837c0b0134b8822a8fe9134ef80b208e674a4",
        "49546aba9ccb5c08e9fb460c7f2807ccb471c5cb2e0e8a96580ba53bacd00c0b",
        "51ec2118c6b9cc413cd1bd72f0fb35931ce1221b7379f6b1c5f378a270cc47e4",
        "54cfe5093b9cfa00861b69956a4d9f1d08fb960a7b36817284b8451deceddcb7",
        "63ad58d4e98a12e8c8124bc878ef6455c25eb732a4bff89ae69a164b26d5cbc8",
        "74ca46586167c00aba710e24c9aa515050378f39fa493592d25c6c8557f79831",
        "82a264826566ee7cdb8792017512e2ba3c33c9e1af5bce881caaf02bb030a00d",
        "8da06f59440b1a055173afce52e53347e2044c935cc9a8a91e68954e6b95b233",
        "cb3cbb74f7ad99f2e56e1d0d01d8b55d5daef1b5be31e6aa80a04a0d93b81ac8",
        "d78b3dfd83769214987e9b62a03826bd9b1b8000299afb80788b044dcc5dd5ee",
    ],
    "LGPL-3.0": [
        "140eebbcd894f9c51f119968a86b6770f531c7b397ff9ae5018b5237bb4b1752",
        "469692e79b6640ed67a6d83b1870f4c582ea2401cc92847cd2f6aaeef7a313a7",
        "8e6f72c7daa671864f276de5d1645deb0c3886044e63c315122c1fb79718e87f",
        "cec338dd2931c7e0f8ef2fa3d401ee7f5898be6ca3242d44818b578e35e260e6",
    ],
    "MPL-2.0": [
        "726fbf916ddd2e7b449303b18ee8a3e00df2443fe29f9d7e1fa43af6d893c54b",
    ],
}
