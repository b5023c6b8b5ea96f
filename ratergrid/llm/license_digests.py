"""Digests (as ``licenses.digest(licenses.canonical(text))``) of common whole licence texts, with and without their
titles and appendices. Fixed values.
"""

from __future__ import annotations

DIGESTS = {
    "0BSD": """
08551d78cca9cd8f1153c6683c74b5beaf8a3a612cb58d88d2adb8e3c20655ce
135f996b0799264a94667b307181b4e708ac75af3dd183e62a37bd0555cbf0cc
25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c
3fa402f4a9b50d2c41a66d3a31f90e95db646212e51142f4eb5ad3922511363f
53695ed162cb0132fe0563719addeac105c8cad72350fae9183e2c74a7c0dbbe
843df9be100ab21a2776200c2594361c829160bb555f44ab1bcdc07b87066bee
9c842909bcc85365ba7f0d106fccdc3af51784431076174588a9832837ebf153
""",
    "Apache-2.0": """
036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b
6aa661403864282a4d084f1551e8149a5f1a7b5e8b05b6db8e1a8a28d0badc64
f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe
""",
    "BSD-2-Clause": """
07009138c2c60079b5c0af517b8bd8b4b42ffc843cc131a20d92d08a8f23f9fd
103c98ea1dcdfdbeeec27381a3e18ee35543712a782539739ec6a31d25bc28bd
10677e704f35e9d68ab40192dc9035db9a743691d71ad0f39d1ae44a81d27e98
117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe
142d228cbf13919f7252309714bfbfc893faffda1e9ce26e9498084a3d127107
18a4ded338bbc2e1519cd794de3c17e3d5fe9628e240824c584fecdebe777a72
1cd2d4d633195ae0e7223a94a138f2ffeb48b5c1e6cbc2bd997dfae4cd96abd6
1e519f8916dca74c89371617f4339d40a4ed3bb71e801c14aa72e8071bafaf81
22a603ae7ca12ed32433ab981867da4735f74eae59e3da680b1fae36412f6288
239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1
23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2
2745cc0a63b844cf79449cfeb9dbecb681f38d964a1341225821c2b2e836d0d0
2c570d136b858b0a4d090e301862eacb53fb1ae2743462bf3b89e602191665f7
2d43d7fea89b3633b95184ddd4e7d55c0d384cc18515de6da01adef25b3a8439
2e9901df2d3cdd9b2ad2d0541a98d0ffe16ec6a54494b7837b493c08b3bde071
33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c
3686d5f539e94a6730fda8d848a8217078e82b810ce27a464ab76bb7bc48dc14
3938f828c79910468f483f925e6a33217162693f71035d6044cbd04dc6fd1bd5
39a218d326b053017477f11ba35cee9d26fdac59f5656824e14e35aad6ac5ace
39bf1f2d26ae8c366dc83591039be7f0d61a26df3e0791f80c2e7dea787c89cb
3ec94d771c239cd0693d2699953dce84d6c7aac6c4f1bd1c97864e1da9908716
447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2
4a5b45ed3ca9ae854c5505a774b3659d3852be9a3412b822802b3cdbe5dc7b0a
4b12427c919036fc08e3d3d6bda2d2d0fed58212d4c5dfc57237af4a66887098
5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374
5d123f3d2076a6b22f7b17a92623627ef50d1584e8cf13b7d4040f1c6e8a0424
6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9
6b5d123c4e3497cba88844d845ccce94cdc9289a67dc4f061541c717d83fd85c
6dd7e504bbd11bc6603ccfd4547a29e67d51cda1d3590ed656ed60626f9dc38f
6e6af5c4dc5cf8324bfc456da10b86a5c79241528ee3a0f84b73257ea213d1b8
6e7a812c94c21565e57090a9d12200f36dbcf7537bf22ee860a7c3bc8a112122
712dce7d673ff7e1550976bfd879c441ad93a2d9906c3c4ae27441d29fa3350b
7412f7ee502b0e1eddedab2fd96afa36a9b61c563743d2d8318ad5e460bc3264
757641796f5809a5392a06e2ef8ece61190856ca9b6456d50797d190a665d54b
7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2
85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221
861c6317132847087755c9cc291b23f25da4024a508ee6c4532b3173c876afb7
8b28f63734bf310903015ecd26ae5c979f31743ca170703b95426d7203774453
8d59b8a64b56605673be69509749febc352bb5f9f7e6cb51d85c9833b5faadd8
8ea198e457465693a5e7706de33522db1e432f04ff13660704450b27221d86cf
8f452105ab504fc07d568e896302a1732ed4200f0fafc73675c5adcacafad940
906e780fc682c509a8fd814ac40be591cd813ee1786cbcda395ca36480fcf989
982589ab4ef486a958cd7491482ccd8c49f9642dbec1ec15dc8c42fb34e1be4f
986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74
9e1e438b66c2a86524cfc461d2a5eebd394b0a5f7d215445d0865050a40aaee7
a22a1b1fd2de7816d322e7e5704778af52b1861158deb8a3cc441af54046dc0f
a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30
add68477e31f4c39352b96a5ed22128c47aa7c46de62e8bac51e8b390c6b215c
b02d799e391838a73a0ccc75692ba88eafccab18abbd5f907e855d22048655d4
b070fd5d70d88d2dc201bf62e27cd5c1a36261a7b51912e5e4f044a2081fc2be
b0b40a4d00b28fd8e72012bcc6d902d43016e0ea2c731164405e009b7f63d31d
b265945940ccdc41492a8c56728fe75bfaf767b67d176e33b2649c7dcf426893
b5335fc56cb06fb488859427303188fdccfe901752d74938dbb3e63c952746a4
b7d49d651647319f38c254df78d020e1c773cbac121d97b17eb70bf3149e7233
b851986ba2da6a30b12447cb3be23018b3b66b382c2f5ae0a9374ca57a089abe
bc1e385eb5d19c6613b84fb0a516cbaef80caefb192cf62a0c520c07f0fcab07
c5cb44b340dfa97436d18371e401686dddf3451388afa1a24c0e410cd7a38b24
cd9b30ab197f107db04da00f4378e43d4fd8ee50988ed680ff3fed81106cb1a8
d873404919cbc71e0a715d0f2bd267ca90c83465f70b71f472cd8bdf28e56585
dfb735646da984cb814b2aab18aef097d6e575950073bd82353f618e44014642
e05d4442cbb8a4ad92ff698ac2d7c6b95a937ca7cf59a5c6c29fb28e69f60156
e74f02edf06350e22d771b60d0580c53e28783fd12eda06abd03dab1348bc9d9
e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9
e965bfe15cdcf092706da02c38cbf69ef02a729b58c76bb3557eec7c8c198a59
f660a20fd170fe8b6282213c3411227a553f1451ee95bd49ed6ca3abe7045314
f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b
""",
    "BSD-3-Clause": """
002ce4b8f1abc08327f935f87bf49584f7fc46fe8139a530cb4ce445fad613c6
012ad388f35541518988bad0e6a944af3db0b25e10c2392a59010f63fc50af5f
01bb09f2f28c026644e75eef256c29292dce7b885cb1c07c10143fea291adc6d
02cbb88221e507a296bab4438d8c41fc55a45c1e486982b72971ef667bab440e
05994a2f60cfed688851df9a2cf23e56de32feb429b305d8c94dd68ef9dc64b4
062a05310a38a72b5194196a22233dcb6ea6732513f4bbd4ea342c44f77c51fd
06ad45966a561f59829f3496a1ae5a8531e12bb8891f87d10370de9e97beb789
06f4208b1e06d0ea62174bbbc9eba92aa23cf805acba076a7e246ed9d08d9da6
08736309e21ef4f4f04fe8d65d940170f6dead365ae956175f9f925b68835df1
08ba2c8a40b57d7373c87740d02ea8169df3d72568c749231ac8a95cb53785dc
08f9385bf663f7d1c9fb390c82cb25f2cb491b288e136a4e4f445992d06e30d1
0907e591f86990b92fe81cb768e011739a49d664d1c7fc92c8953cf6eb7a499f
090c3ed106465d7549e9596081c509b8f68967065e1b2de48014b997af3d9ce5
0a67c8cf8e3cc7e532a8dd801f0f5897ae039f6289ad852aa229e1a2ac78d44a
0a693a9b0f9f456ac1a8ead8338f14410fa65b203bbad63be901a84d32b36eaf
0b22087ca888f97602f1ff316d5a901aa8c4e9c1137251db4137821031ddfe4e
0c31f26da79530098d99f109c5e5c087b533d3212f08f3433169de29a180d282
0cfd3fbaf9fa4ee2c97a6dff76af10e8bd8a0316151df2dde56b83ab2c68867a
0d9569accbee32dd3a420896d10f915d23071d627b49ca2f194661b3fa6aa139
0dc9d3c1e5ed0c73c8efe65464c7fc938d78bfd47dca704d68fb1704279b1843
0f4b00e6a717888a6af01dee97d72faf0f967aca58d345a5bc57dce7f9c4e399
0f8f286ad5035888dd1e556b4a53f84157fa8d75fcf4c13bd6778f472774cd4e
0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d
1006daeb1324c9ad53d0df375b702acbce2d142c9f26dffdb4999842f48ee2f4
104d90383a3bb3b4f6efa9d687875d368d6a09fc13096d4775fd5848dc4ca875
10c89c9e62f2b6c947ea137f0e621f0a633a2b97ff8969d9287edd3355157916
1157d7738c8e4b9714da26c13a27d402141a7cfc68c80f72c30fe25698134732
12fbf077945002dbc737191a6b0982a5f56415a06907f679c8a3a72ec8f8ae69
136e7f63a0a2ca2a298405efecaec7205011f4750b423c4dcf01aa610f0585fa
13bd4956c077751ad193b5da48b859c64ed6922c7c2b69a588be360696d979c1
1430bf398603ceecf5daf3f1493873af92b11fdeacf19b6df58da48a73db7ea4
145df9b6b3ae334aaede429d7eb8fd29a4c46cdd8d75f35e74a4cd287a5bf108
14ab22599112356f4f48b9628da3a3162ed799b309f638ab22e98717e1e7421f
1508d3044684b0b3033f018bc74bbe140dd0afc619ee6275e6337b5bb1d08190
1546ded82f08dad5f9271b14bf487b5c0f27e6260a2382ea4621656c1d761404
158c2b9b622228ea40accfbbeff48d3eed2fc31c7d17e6d4dc32007d6a25a829
15b03ef135fda7bdc026f239555d663d1b16473622b88f9d3e513e1cfe9a4ecb
162537e34c6214aef31257756ea7a4ab5da6e66501fa71992fd77a9200816951
16db4d4157a6fb102b89c3e41b88b39186551288dcb00bf376829446190230ef
17315dbc6c309787bcb7c706980cc71df3a769df14c28c564ebd7dc87cea833d
176b24fda4aa7ba80124c4310e8a60078b1710f1db2633dfedaa75fcfb0c09d4
17cee9607d52bb6198c43a77342f2bc0c845514239755c9bf1128943d2ad3783
198696ab639e3e61c31abf853f4c3d8c45d70c0d325d3349b1fa4647f35dd61a
199d1e35927dd560cc06edbe07ce73f26df0ee8e77253cf48c7390e445849839
19a4781693c27171941c3997100df63b3707e99f2135091c98fb3aba3429a921
1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75
1cb774cab06cb9b7b6bc35f61dfc1901473cb3a0bcab3e045bc6f74c3e8fd4eb
1de857b024170679904cc5312e3c0ba9745a155d5302a47b7affb0d2913c9dea
1df9653bc861bd2d04debc888c7520b12f8069da758fe64b63338ed87412a59f
1ea725e6572a22de6d4653fa21824d67cb8adf234fcd3807dbfb86b8715b3511
1f118e768861f939ecfa3d06343ea361cbbf3d1faa4bd0fe1845874d305dc5f4
2075d3704febf2d4b906c3b61966c425544e60ec180d0f07cbda9650b18b956d
20f6f12aa8344cc6bdb0ad94dc9037f7dea2ce44ec09b9d5b0b8ba510fd7e903
214aa9c28152d6d77e6bebfb4a7511e677f65fdaf94b0fe9c0bb580e0eaf8997
2170837dff837177119bf6532a1b1864269accbe9b681c79a5807a9fc5ba5aff
2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b
21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651
223f7c9ea40d8ae00d46b212a336008ea24befe40b61ec212e7ffb2a6154a834
23f641774a41eb5d4713b513c6e9f26ffb65aa170f01d2e0829262c6378e8b39
24a2633fbb673424fcad9260269d066fef686d9aede73b785640d29fbb6385f1
252eceea4abaccf7017123c373d66e686d12a7f59cf1e7ea1eb24c1b1f5d95ae
25ae1a90081429617a16f5636d4bd8889820c0859cd0a9e123451159f27ed8b4
265040845e36f921fdb024096e18f6c39a424d38e5eb6c04f6ef8eddadb2f313
26ceb0a978fd83d209cd22081d8636f2b41a1635ce06d61210c1380663ab7eca
276e41878e5f43c0783bf75e0d74a5698fb268956b51a4f2079376ced60f4fe2
278b4e82a53b7edad51b4f075e0eb9c266dd61e97b5b62b7824c3e5befdcb62b
27a2e1e89e7112620faea164ab107b2aa62736c29f8447674a19f27a4b44d972
27fc5566f50e542addd6ee6d6da5dd182a6d4e5ebc88b6b0967d2e0a98b5c319
2862502b8c0b9e2898bddc193550da25efbe12dcc633cf5c250c8acd75d2fcfc
288b16dd057d359a81060ebda0feda90773042673f2755ed83de86dba322bba8
2932b3a9cde14d92689ea32ffaa4802d182664626e56440cd63686a1482cab70
294c37c2c1d5ed4d91c4a58596251308fa458b20702fca9bca3125eb836ec77d
297344a620b55d1acc68e28aa9c43a98db5d5efcd0c2c49688fdbd8d1cda8fb0
2a2af4fe0a0c9e8dc0f8df538b0df789d036fb47c3c60b1f493cc8dbd0720505
2a4386d4ecdb97d143f06b73903fc9ff8f6c02d18e34a454e12468669d45c531
2c20a3f30adb36541464cf5345b51637cd2a7a7c34009860795c0c8abcfbab99
2c25aae07605ec87a119787e11c83cbab5712d4b97565e740f3dc4d9c8b04fa9
2c68b67886ccd0f6091bfb3b3a840083bda8889d6af0ee4c3bed709d9ee932e9
2dfca8298e56d83221d791d1ab8e89de0895146e80e040a56e7f82c6f21701af
2e4b0a34131a2b469031a5b604fd53e3db5d59daa89a252e88a68a82fd44ce98
2eb445d3c88b2a08758bb6da0c3329045b18ac8e6f1f8c3c2243530cdc9556d4
2eeb83a014804a2016a7af525b5b7f8eafde56a49c2f9780ea829782cb9b98e9
3014e5dbaa99d3cd0d6bf4271529a9c867c2affaf42078a80eaa3d6810d31f06
308ae1731f36a41b3be42b706243991b8b1ca4bfa0e8d8becc3854e3abb29dfd
313c935ce5fdf872007e05073f3b7c337787f38b64c73d34362a706e66357338
317cdbce9b66868434a6f7ea81f11e9530dc4aec7a5df51b2714de94085565c6
326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903
328a31843f58a876c6ead2604a5041aeb2e007af6d7f19ae771aeaa813d47b88
334239264ef811f8c689bbf963dc1324d2da10b588bf2be3d8d44b93626fa39c
33512bc1af4d9489f7408d3510324a8001aabccd277956747a080461c97522cf
33aaf48a1bc03ef399d5b9c0fc83f491c4104c082f5234085e033b8a7d558c26
33b7cca4d938e1239a92f66f6e9764248a49d3e1bf60a1e81c3437eb5f6062c5
3558940b39dab78a471fb340f6a46d9c8ab5a19df8f738e5c348b2d5f130d23d
36320377bc712df0228f7cd02a978b1639d095cf14c52e5a4eba4e1b3f56ca0c
36ddb0197e926364a81795c23dfe3ecaa618414047b190875c82897351bca7d9
36fdcbfc8124635e7071d0ed2271bd9cac0cf975002801d50571c15dd8465554
371bc26c0671712ea9d14b25f4a6b6b394ae2e368ea354d2eb9c54b5f62d44d5
377e96a3928bc5aad18412d9093012074fecb6bddf2f560efb57a9fa33dbf200
381a1597c60970e78836bb7d9da99e690f5a6664751fe19cd5447f6bce238970
3869a7eb34eade633338d788feeb4bab178a8f230053a14abe96d8e1fcee2046
38fa623f1dc4ad407e098bea1325b17a23c5e3cc09703941d537975aae1a106c
3928e6b659efa00dcaa7bfa4e4ad6c941b4bad4d709351bb37c776e649acd266
3a95159784127c56d35a3e84ac9d2430b9abb96faf524273abf4352b14f0c8a7
3b1e27f1ac9bd5026af443e30358e290466f9730eb424e0ea3927c171bf9991f
3b4db0a6e1494960911161a55ef4bc0b878d7d58c280e2e16f189d63a8ca667b
3bc6383f474bdef239237d4a1b5040e6458e0fb36c60e336d36cdf40edead279
3e851ba3abeda8236f3d3bb054c1c84ab53a06370ea9bdee16bb7caac31db2b4
3ef5667f89898f55bf8e971cd73fc5978ae7eef3b0456dd1751192c0cca7c863
3f40d30c80cd890ab1934322d28e43e97fc9b9036b82cb2afd81384fcb3dc29d
3f6e2d49daf7f73cf7d10aa86c8b8249004eb26683d11df890bea9c34d9cf4b4
4079d1a9108ca437dd29ac26e1f73dbf7bb3b61ba3392438373db7018cf188c3
40d919d68c6e6279b9b6dc7fc026ff44270c31e0d8c858f6ddd428d0318f706e
41e953a81b97d4d49d183543aff2c7f31e7bffc9548893292f14e70a9bb876f1
4241a91ed59fdc8d1c20d065984925429610744add02cce3becf94e4e83c49f9
42ef63a784d8f87a9f10e3bdb7227019c3f4e5936049539151cd34911e97fedc
4317258576f7e0b439c9f302a40656ca5c4771a81a49e204b65571888e7675f3
439b47ad2badc685d1f839d73c108dd2fc0f485a8fa1d8f722dc90570de9a0a9
4423b927d48a99a6e57a3fb29eb26cd2d176c5cad10eabc6a36866553cc6159f
44d5f2122976da667c376147638bbb5901091365c00f6f5710982f5b3f67d59c
44edd7374ec383b2ab98b7c8dfce2cb1384dd703eac04d9230f6a02164c8aab3
4527997443fa43aeea37d6acc830709c19a53b0d0ff0aaa1dcb7b9fcbbe71fba
4626de55caf0516a612eafcf9dcb71eb7c481c9075105bc72fc7685d6dbb42cd
4686df9ea7ab5e1d01d0223327ec627f8ed6d77fce143485282ba5f7747d58ce
4801461139905856ae4307820b5a8f00e642a46c85f5884615c4f78a7c3baac1
485f1652433b74fd0a8365a4a059bdd82447b5d2a002546ff824eb1a3ef728ef
4885b68e995e73a392d84592bd9afae408201d83afa327ac1e050aae9c509ca2
4898509c3929c3aa032c13508986410d68ff1db07ca435c3de97b8ec26266df8
489e9a911b933f78544a1639ed82de3c9be97612ba439aba7b92b78bf73fecc2
493007603f0253126a011d6ffcc8904a4ad632111f51506fe9dcd54ec01b1bb1
496a88fb77f7cf55994de8bd2b87ac0e9302e2dc1b11f567dd0447f8f0648ab1
49d4bc72a1ff6c779c3df162b67c048b3e6e670172f2d9240678059a3ea31474
4a28e38c08b92fc6bdaa30147f25eefad1c4645e38a5d0f1bad6f462a55c6200
4a766107da02f2fa8691d5bed52542bdb4e078c451586c31b44daf16a5895071
4ac4f1c9d41d42eaa4e7c92a39b617a37b885c287c79fedac81778ce57e56fd0
4af3efd27cc12d2146661de254afc90bde9fc2c708eddbfe69013f2c8cf24654
4b87558b5de555cb25f89ebf763f7dce6a23fc7f7fb0da6c1727fd865d11356e
4c01287765d4770188bcc961fc5046b414b09fa8b984d16021bbf024247187d1
4d4c7991eec13c8481fd08902fee35e8a6cb959c727b7aa5dc0c4ce6bbb9c6a3
4dca118fcf8557d8ebe826c91520df502fdc017fec0fed23de1a09626fe8b164
4de23c1511f37d9faa6066a4535a4f7999390a0f13a505eaf6c05933245a26f9
4e2db2ef4c2ed34a22e7a664038aa71eb7338d128ba1c81a7e12c35a98e3e3da
4e8e26c1f48eff92b83d08f426f48454571c455b91fa9d41ac61be50d5b09a84
4fec7901c0764f1c632da504aa28d5de5e7e5f0783c88d1e3fd21de4f97e315d
508f2c874137684ecd98fe2fab8f14a75320f9add4dda48a0c6e810fdf5d81fa
50a52e525bbbad18027648f0544c1dd2bc68264eb5e968d6584aae1c35716535
50b347119876e19917b49b5c0c30041fecb938ed87211d41260775eb66ea6baa
50cbeadf6889724c7e6baac328755671f30f8e0efdc011024c174f88085319d3
5112931d0912b35d46ee49f15e1854f6f26db48b1683933184025de1c54052c9
5135cd05ae4ed4053152286342eb7463f02065c45f7e87e3aea53befeb96759b
51b5689379a85148d6c19c03ac2516120a25eb38d3de932674121e3611f79972
52488cdfc29bfa2ef46ddfd827785f0ad9e9fd9759af5bebe456aba62c7f867d
526c9d80e50fba16478ef1c38774ddeff9ec680c57b65becce7e2438dd0f566d
52708ae7496bad323efc341f2b977f4deecc250729644235974381dbffa10b45
52a8f7b5a4e5a4bbf1a6338d139c576a70cea4f01a64468d1579ba3a160ca231
52c8e1f1387429e4ac2e46a159e2b2d17320de20b05dce03cbd7a7cf9be73702
53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa
53abf9d674e1932fae7438f56165091e8152c2401b99d3c86274bc5ce20deed3
53e95d5835346bceee7bc9b20385717680c4c3ec312eb7e5784ea7303bff63ed
53e9f01e509a53fb2c0182bd5ec23198b29cb9387a70c0207abc0031a24908f5
5477651eedcd305d5873d2cf6a54f53b39b8d8d1719594eb0004e75f1fef45c6
549a0b4960f4ffdc99ff68cb9cd4c3e22cb7891b5fc166e37fbf5e344399dce2
54a11abe42208b3ea52a7682e9597e365d3170c949afe123c4a0ea6fd698cfe1
54eb99b1ac424b81afc883627cc5b119ddebc92351e6240eeca418beeb52ed73
553ad8c9b4081e1aa29c6ecf27ad97fd4f07ce1f3cd4f3083581b5f54f807585
55a38396e1487a5929d0e20f101408d10686ef50b3e56a97bf01cd2a8d36fac3
55f86b555a628a29b6625f8951850429f117f7483c94eb44deef54ea9d5add2b
56fcdd77f4def1b42be2575cf5041c3fa6d9dca7c8f3a68d8fd97581499364a7
581d36657b4ce15fbfd1fa333b1fd8f021d557c43e25cf078161367b33babb4b
584a6aefeadf84d442ee9defec05c326cb9a3d0b509b1d6b498681902ff66281
58e1732857c8aa35955ad62b01f08c06e94d47442fe34fda957db48b4ad0d2e2
58e4c5efa4c492102f77f1e5e41824c05ade0f5f0ae7ec9cb12d5c7ba8bbeec3
5a282873a965269f59d28add9b75e3ebc8e26becf8fc42130c04efb1c07f4b82
5a4a8574c9001b24cbf954f8ff152e19d697fe266309343060d8badd306361a7
5a6e7ec0b1ac1e224277a8a6d5cd7691ea38298b0308b87a7a2e539d020ed1e0
5aa33a840f892132ec5958b95fafb3c4b49f8f9acd7c24d65d74c61d1393aa4d
5c35f4e399c3dbbbbec39b82929db400727dd320bd43229f760a8ec78463acf5
5c692cd7a6da0f93739cc5962562c03feea963a4688cda6204065f067f8a8533
5d374bfeb31286f846f4447839fdbbf046016de1940a2218e714f74592d5414e
5db47eaf7753c83986179975232a93ae3fe241393dd7c8badf56b6db4362de9a
617c063aa3018b7e59a8ce96caf29b387ed47a0020ee62433e1f6787afc90c4d
627ce5da9b5340eabef312d3c5a818c1efe5abdb1f8a920486cfac8d1e763269
63af53fd1fbf09af6ac254fa47b5e7a58be0108be793d5b3a7cea78be0afda1a
643c155c9804e90946f87546712fe214b0b29042e61ffb8aeb947fdd9af3b3d6
6471473b7ed7e798261ec5291292f01ff34fa65af36d81fb499a6b2d192adb65
656d8a9660ef71201ee84e0ecda348f144199677ffa1d99a23b0eeaf4883baba
65b7225c979f9ba83825a02b60ff1d73cbc8a43dde56477655d9b36a60fde54e
66b952d0fab0f5948c67331a9b3822606c4208f0f04b8ad78e1c890a96a2c809
671b0ca57c04cb068e3272dec994468e03f74e2f8bd2fc1e67fb1e1045049dc1
676a94eb0055b4bc8cd6e642eb3516d9ac77586f89dfeb82fa6fbba4f29cce1b
67e1d2ba8130577dff2853cf12d8539420a4ff6ea3f278e4f0a68094fb3572a5
681d21e9eb94143c16a355a1719d0195625225ac368298353ef1dcc30e6cdd9f
6879a2e5a31cfbe41662378bd0e807b54603e40ba10bfbeb55484d803ae67da2
69083549410d2f63af7724cabe9383c3da756a9875b71a13bdf06f218d41d7cc
69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71
6a271d72d919880ed26bb02045e8a4e05a85e0e98e278dbb7caefc4d5bbe8e69
6a794051fca3bb53638164340f6c2263e652d548fea0d01b009536b223272ba1
6aee8940ea49459164467e0c55499b7e92ac4571618b9b9e538745b2c40761ff
6b447d18d19d7da8f98936feff9dc12a238d4fb355080af57e56d70f31155dcb
6cc04e9acb959dcb8ea941e1b3496e5b6b4c29a24956436ce51b06213b15f11b
6cd2ec4c1707d264427cffd6a4120fb4ce726f221152e3e5c63f8b57d2e1693e
6cded2d64ede823606e0ad912d43ef7cf641160926310fa31217c3749fa32aee
6ce850d8928315fe772e46ec60288837667fd6a0866b2ea114f45938a5772e7a
6d19f415b62c8aeb74728e43b071a3143f892216307408a050cb4f9cebd58ee5
6dd35bce98db3fa45a370b235b582cdcb2284ef2507066048a386c572223f19a
6df4d342265aec238a7324e96f109da16c18e5395cc14be798f254b47f23add3
6e636cc21b1ef1a5a79ac9b4c43b18da62350e54cca2ed05b4bc31361d7a9eb3
6f922c6cb2a22faa1c3d9be59103bf5dc2942321f1c76cc3b6f0772aa184826c
6fe598122e1aa2b70062c6f47fe24bc861d8d7933b9783fff19b948b714e4487
70e29a5acb29bc1a91295cfe0532eed880b869282421182fac73309f47dc34c9
70f26b26e4e1ebeb0071b4ef93598d776ef7e9a0cda2ba5412d547eedcc458bd
70f92f35862f27c95a390cf57675d409d26cad237a81d89d1e4fd53bb8588730
71c22a2d0b27990657a3afeeb55a4d5339bdd339f5b7a14e0a973ac3e329a14b
71cf08b8c05578254c14bb399fc5a7858151620fb4deaebb8570c6b11f37f3a3
71fd17206d948f86a304dae464ab3c435e6b52791fbdb44e527b6d744e4fff57
7214b1b40346b4ae8e79fd9c308261fc305faec1bb95429427529eee256466ef
72b1a06b1bd5bde36392094bf4e5144c7a25fe215c30d421928fae268dec4a73
73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da
73acb939c7f6dced1dd8bf6eba3f5f76ccbb44c91727d9eb24f0d1547a892d41
7422b09076b2952e65af7739fb40d5a3e157f7ac42ecb34d14d6b09e9d016724
748321defc17decd4d7c5f064a98f5c766a66aeec2b05356ee253d10062349a7
754225f178c5769bf431aed5cab2ddb57b66b6704bfdbfc2b743837a24c40e2c
7635b8b4320eecdaa76761876228f8e02bb77069a2fa2ecb9d632d774675c215
7668aff13b074ee8ff72fe4d1e7a5866b755b8fc00cd0239e4e80aec12f32127
769947e9b97d3ed0b08a0d5c869878736c09ad44f4d1dec0384fc982e872b48d
76b173bb2a6492f7941f15493bc75af0a3afc02b9cde5cdc0cad10b180455932
77cb7c8cf0cce8885828623c9a5ff6746904c3333f6d2506204ec7c2d0f4ffc7
7ab3fcd15d1f3fdc9aa085c2b6771e78551b3308af09821b454099bd24a2a1f9
7aeeeae04683ca2146c56bd853a6dc04ba697e70531fd43f1b6923042fd1d204
7b07d52b371270cd9cbd1c0da0bc379e7e450be6d8f74eff2ccc4f1ae723a702
7bb2a58f1a2613692218c36c4b52e004c6b230ce814c88d01ee7692bc36b3431
7bf5713ca296b08ea88a5ab4dc815cb078bc97d56fec2034952bc7d8ba65b4dd
7c06d139d208d4998b0b5d71878e4889b0c1c94975a2946aac6cd5fad0ea9f34
7c16b387b2fd67aea7403110df9457eea9844b938eda62df5f98a56797001ccf
7cc981be23f2f000f0204472b2422100bc6bdd398bbf8b22a55b0c9877a23adb
7d9f3e966fb926e41f8368d1179613f4b7f5c6b7267eed5163f54ea52e72ceff
7fa309b964661a7cbacc4171281bb9329e738c70866f6cfe9507041877a7a6db
7ff930ea71849aaf0c835ceb1878a1b5701718486309c5d8319d01a8a2bbf8ac
8078ca96ff592b24ba127e14c7f110f54057dcde2c6023deb34983ec3e23196c
80872c60e7ed1b5f873c59f418ed1c0369e75e77a5300daba01f66bb9f384d97
8105f5b5a3418d9a23ebdb1759ae524aca5d03c381f835fcc8fcf51ec7a018d9
811a0d4ebb0ce780830114843f58a41dc74ad52ee6ac72f61b9ac6789b30b074
81653dbd1b33c168008776e703a2f44797b88841e2758ddeea5e632652a79a9e
822589365a482927ed17e01772f75beb89b8f814727a95e47a6d015923356736
82e74b31886dad9cbdb6f57669b85106bf87218c77b53f2aeec5da19bd9ce067
845ba3fce0ead2e85d28b60637f5fb13855d17a9671b18a047ea752007aba012
84c0c1c00ae4181e22d18a17a256b25e857303c5949afb010cd9127baf87dfea
84c781b5d7e3445d472ea78f86da8ce1f7cf3f8a699eed9e76e2fde2284fa9b6
85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65
8604f05715282a03395883d1d7914af0db87a549b46531cb4297d2888fe3739e
86530fea5994d550cab54037db3fee52a6dd5ddf1023822636f62cc7663a0f68
88336f441c56e72415e3f287e68bb9a6848332ec68a33c45653c07b3bb5a68dc
88795ac0b1bec6e0a46e3de7dd4549c44e46b8c1ec87c57fe3d0b8d26846953d
892364909b8bf573d125c3a1de114a6d55562fcfe2d3c039445227a5b409aa91
8a69b3ae3c37b6cf9ce330b5e5e3050e29100621d05ba8c828ff817e2e6556ef
8ade638323b06be3951b2c6a8ac27489a02d9bce0b9baa223586a0136cc01098
8b27ec514e0562fc4eb7fbd05f136b779dbf40da63b34592dcdca970f30caf6b
8b88fe5cd436a9a4d3e82af9529cfe2656ea0ed422a8a277c28394f0be169af5
8ba6133c391f099f3936e999218e881ea570d37c2b504821ed3199d4b5421c47
8c43033e30638dbf655a64e3b9cb5ad496739e3265cd1173bf9de626f4c07b0d
8c522fd0ac9d7a67d2a169d7b259fff40224dd0e66ab466ff7112dc6b6c6a0de
8c75c628933da8bd306f29be77b5b88575e27258912236c9721ceadcd6c79fd3
8daafb52633012c89cb7d69b91cb803859fb5cd5020eecaf429b992ee55f23ce
8dc21ff7b03c56a4525cb300a1ec7de3f8b109162739a050618d60042ad2f78a
8e06f3eb8c471515579052a428e5ab2d0777573b150dcfaf3c8b86b61989c907
8e5a0986e48de9a9780181128f05245ba36db947f0bc06d5d3141902aea6918e
8e6a00da3b41501414630318cd39ab4b24a7f05ff2efaef3b6ad87f3b1745747
8e9f8e37ac8faa2bfae32ca74748d486612d4cfd038223ef714d11b5025571f1
8ec96ac102a1a4e8a51586c5069c7bbf5b233cd4fd6c2e01ef2e376f9fbace63
8ee71ba9429ca42637617cb9b7dad89dbc9026b289d26789a7232e6abd32265d
912a9ee21e203f7f4fadb3c13100e62bfed142edd4b67fa4672c4d62df0ffa5b
91de3da9fe8994720ea540101e81ebc20e66858e245c0c80ed144212aee6c6eb
930f53c7dbe4d2c485d96209119bbd2db693afee46d16c5f8697ca00fe66714a
93700e5baa22b381b53860228de01a76cbd7bcd688ea4d2bd033baffdc0618f9
93facae17cbb1a8c467683819001c40939dafdd0d006162da0ba18d04bafa3c5
94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f
952bf8aaf11b0f969a809038c42f0af17a052b160b7645b10f139d172a5672d3
954f9e7f94856f2a733afbda7797a965772b7badcb9227b81917f5f8b70c6a6b
95a3f1d16cbc6570bb6986d13f3e560e225c5662093d80e83cb238567b6e669d
96474c606b7413c4e96bb8d9d2a763f57b89b6c63eb98013cad74e2a17ffe914
96d6d9b21d4737272bc8692f515caf384df0f9ffe7bee4881b6195ea1f032e6d
96e5a71e590aade43763cefa2e214b352f73270077eb2d0efc3cc00e21a5abf1
9806d5ad08cab1db1bc91e40224bd4563081ba3c568e015be77a650792bcb883
980fa46517b697fca895318e1a9704efceb18c5ef99e9be4389ac93254f87867
98b1ac86fea72c047f6a2d429de076743e0a7d0a1ef6208737623394ca99bb6b
9a555874297cc48b4c505e59638326e6e9341fb0af3c199af45433b2f33717f0
9a75c764cef557bf1ceb508e7e136fef3cdfa4a8f69ded1376ed94a2e602af46
9ac2a8d687f8f027199caeb75375c6df77a9682afac572cb60e9731941c458f2
9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2
9b95e6b9046b171ce23146e7b8a5beb0beede2c854f304cee079a2b9eeeada77
9b9ac51f5ca1f4f99ccf94a0770c77723a9b4a5eaf09e0de3f8c9ec65b1f396d
9bfb5508857021c9a5dd5d7ec8c2485175fb0d076e0cb3f3be7caf2336eeea8f
9c07b35bff4c7723f05498d5016671e6aab167812efed57d22d711c2877f486b
9c5b8bcf1caceb8eae42e70296f487dca9c4ae315b1612f7e4d178b19fb975e8
9cc754a91cd8a8e29189ea54be5ed3692f2a8f2ea466c0685f5a7ba146570e23
9cd680d56db42f3a510ba3089570ba3abf28066291ae57ecf32e4d67e6527310
9d35da508bc9f8b6c079a39f033dc94a53c80ef10a0e9499c6cbf55882ee5d3d
9d797d16cbeeb5c9cd79f1224ce3e2a81a5f5e14c991edc0f444ea3bec5388fd
9ebfd38e6f2daed1e23c8594cddfa7e8cd8093e995e79df0da1e90cf3f8222fb
9f0362afb460d3e8bff2aacf4d8ae58168308d08e7d33d026924bccdc7b5a3fd
9f391d93a29a348c9dcaad53cfa5b22986e25a79bd1199aeaa924fa7c7498e6e
9fc4ff78d8cc23dc1c70c2f461ef462b77836e35ceb96a56d07a134369497316
a06df82de55c78a283b2dd81105c51f24a3899ddd8e49a08a15b8e55885a36b2
a09638cfc65d44d1e12770b72c647e791901bb081cb01f80e8bc4a1ae3a49cd6
a14a2f9c34cdf89b7a54ad8a079178aae9a317447ea94fb94a41f6b9a421bc79
a196d630887c3a343519ccd5e202cc4617ac5f655e4a52ae5116272f816d6073
a1b219564f74c286b8e6d513ce628a398682d68f7ebee4316d742d704938f7dd
a1c11b37b7a07e569b12d835f4cad651defb84da52a2b8e47c410aba95685cc1
a2a192fc112ab0701bad37b062034057f43dc6702b603d5d45a3fc3560b64f12
a2ec481ad273e32b9116be38e2a471834cea10b21644709e6000a0341ee6c5b2
a322081ed9369f3c0828c8cd4c178d66d3a4058550fa4226ea6868a3df54add9
a3ff29214c491ad9a01d7e24a228d4d2015e7a3cc6a7cd416b9eeb5f5d9e8712
a409a729c6206d6b1dcb093df9039b4cce7c6b81536738d196e5287cb4ec2787
a53e580fc75f0796cb935016bb16e0620751c620a261b19ac040369f121b0479
a53eed9fd9bb94ca20cea306dfa500e66d4176ad32acf62fa9faadca33f69c4b
a56bc397db71dd0e38e476dd3b908e60e53634e2adafda1f1b6672e57be1ef0a
a5a573db8b91209439e7e29d667630fcd8f9ad52e07b4125cbe5f995281ee214
a65aa119a9ae25139c00daa069f0ba1397cbaf52bc0cb15bce536c93c866827a
a71f9eed552d590fc3fca7c2f91f4747179c9ebb4699af475c2c6b16b6c13f75
a76a8fa24a88caff94e58c2be07f4877f9164318b73319d6c468098bce300811
a772d5818791ac44ca752b2f36a65bd691fb6827311afedbcb995bbfc44c149c
a85bf0ec825479a5278008e007af732ff1cca3e7f5272d4ea99efae10acaed1a
a893c2ba323ca9d991baedd41f2edfa59938a11d4ac703d5d2f538f124e176d9
a8d4a9802c5624c8e87a1a403a26294c46e5ea1fa6d022df4620bff578b45dec
a9142a769338a6880e1489c9fca32c0fc6a8af62615d2a5c3f803aca687aceb3
a942b773c76bf44b8d7ce5b042dbb4fb4edf3edf932ceb86dce1038571886197
a98dcf53df2bd8167b86d686bd31e35ec3ce68b6547752821db35a456f3ad5bb
aa7e66de4894c526d52cce86dadcd94a034947b19a8805875995994562152ec0
ab96d546e6cc543d5b4293c719e371f5b0d14297d55a21baa6643452a92007ce
abd508f8641a1022aa1727a995c94061b4da24b57c32168be2865caee8de1b85
ac558143277b4d5cad60fa3fd69ebfbdf2a2319240bc06fc6223728cbf5f837d
aca8baee5277c1534dbaf3015b9e2ee306bf5cbe6c67dee61969dd7f33a87dae
ade12662c564e983a0f25e57ab9fde94bbd8cc6dd5d3c9f0a0171702b37c3c16
af60b6e3f024645707385ccb0e9d32852282b03a39fc964af73997db8cb25220
afc34af95b6dbbe65fba5dd41f6cfc4e3a08b5e3c0217685b4d75fe6880bc343
afc81ee99a150bf9ad976d1b4b3bae3ec8fb30e82c7f9ec18d0048b070d2ebc8
b019c75adb83e4ba417101dea8fd3bf3d0c51723b3c55854e913bb115b06fa57
b0284754398490bc7f7e771a444e931abbb4fcf66307338cc77f0df2c2cb2039
b068c49334dddeba14c9c5a12dd3a219b4a3cb220b191b2a7b025e8417a66ced
b0b47238a1e6ab1d29d4fbb4de435cfd9d8ae32683649da50da189c31ff258ad
b214574a8040a8d3ab6e9d15d42663e52a7d76452bb54975e31c0d3ecbef5556
b3b7d0fee6284e3d41dcc9329e1c35f952a447360704d97c787fefe21bf2567e
b5d5d48337502fcd6670c00ce4f7072a903d7b9535f1ce16443303c3349c8760
b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9
b8692fbd0940a6b71f95fb3dd9821918d63595ca73a8f6a2dfa596f5828dcf6d
b93a5e00e81b399c658f4f39b3c6076f9fcad25c160a0dd6057849dd3c310fb5
ba78ed9fd03730d71d3a6bd2fce9fa8318dccdd2bcef97294525377acef720ba
bab5a337f9568f6b3abe74021c71d8986dff6e4b16329a8064041baa8c9f77b9
badd192a9ab6c50f59a60e68d31eeac39a17591cd50340482e8147132cd95712
bb17d1e78bbbe62ff8673ad110ea7261693b72f37d93bc54bebe3cb205e66ca8
bb74e63a1c62eebcf4d39c326c5cd525f023053d0c82fe05acda5c00ad64fe34
bb9673c5222873ae20b44ed8adee0126945a8168f2e943b5cf751ffd142f5f76
bd1529581253e2f061831cf3536252806dbb88139d01e2c46f954dbd99709aba
bd19c1d148646bb32574e46360771abe9e932417d1d6c292ad1b5bbb375b17e0
bd7d910c4d2db198970b03aa0712c2453834c2245727445d4d1552208efbd9be
be6ae704e8a231ff9333b0a7853fe1f052169fc882774f4cc1f98b1788b4e3f0
beee3d110c1156e4afffdcaa685f1c9721f73d276806896ac23f9135572fc76c
bf165bcfac87a96777778224bb833025b28d642edea861c547fb571a5b4fd284
bf29a39d9d83a77a7438e9e73578ec38fa6a7e3d24b344dc10a3c55a901d0117
bf816177e8c6114c4f0571b609c0b44e0e3d1b0f32299bd5aa03c97e8995f71b
c054ddf4de5be89534684173b0c84cfca7015aae7967e3a64c760d25ceb8890c
c0cc80e9013aae3515c93cc07d3f8ea7593e5f8fb785020bb21f9b21a99672ed
c12c049b83b1608599e69848ceeaf817c71c14eed20c1f07795fc708b11990dc
c179fac6c1548b411e49721fb1323583d9ee75997509952476b2adae22bbf5c1
c19e45e4caf36d04a07032e4291ae19dfa1ba7a438b4d073c576d8271eb7dbd1
c1dd9261eb312a7ed0febbec348c0aad44c4ee87313f962599141e361cf7ae5b
c20bd9e9a48d3165b5e500f6c32225194e99d15723430c8466d4b6390aeb0488
c3c37a3f2460d1e6b986324f6532d2e7c13d17671d91e5ccbf8b24d2caa2a3db
c40e1b17ae4c0807286fe53911e6e6f4f9c179932585ed71938b78004a0ff14c
c4a81542cab4792c6cea36ddd246f3f48dc71916aaed957ad14400304fee5b06
c4cfa50bec6d1b453f7dddbd917ab2d7c2a3134f7ac85cd90c8cab59fffc0da9
c52c7aeb37fa55c11fc08f609dcba1a1e895b105cbe35eff00f409776757394b
c6b05108697229cffa4c3c4234c0eb8a75b86267fcaa8a540f077630d96fd010
c795502d0b817c0f238e94a41ea06b4e94de752cb5c5b1d2aee09502774e4159
c86d75bd19f935ac6c644509e3159cdd3a6b0519968c41dc09d8aa09542a9ffa
c923f0176bf43797c3b86a4a75851a9ea679c9901d7d88632e82b59903e8c632
ca391646e206c466a562568e2bf718c20b25d7a4d64d3d1bfc033666bff6229a
ca651e3305b037f4dcd4608166a3c06d0810fbe66f7cca0526e2e0c94f6c42ba
cbb8552805c7ad1995ff3693ae2af294b2ec8e45c6783227f42badae7e4c2acb
cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb
cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15
cd1d3eb5e22623fccde8241803985df22575957de9e2d7365b0c7b8f118384c4
cd86bd939dbfa5a64f1900db908b1a478e6d73882aa22c2fce6204a00a5e3e32
ce5768c5a2c437eafe95d0560368dc27af077dc008c1f779e3b063b77f2d77c2
ceb36b0173297578925e297a5e163a7f0f988327f28c8eb9654153d4354b2598
ceb539a14a135648f303dbe38b2f990c43786bd70c95bbbfa427010d5444ec1f
cee5052ab0be330a802e3ef2604b9c16f71a5e155acef3a295a492ffa9eb6285
d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060
d18a9cf83a168e0fb64a5d254735362137270d0a1260161abd56a7a28c5933cb
d1e1fbc595323f5142153708d334c88a40cfdf288f8491af1833d4bfb9c8c774
d1ecc0a46c23dad7f9e13b19b877e5be7ec9d2b9bb05a2dfde2e47be83438590
d22ab9cea86dd17f707dc27d9292e3c4658ef6ca32759a0915be842b470094f1
d34fa857d627ea77dfe0d6f8c4acf1cdf8b1a248b4b36b14be465bdcdda9e8f0
d3b3be4ec9c5c0af1c71fe9ec8d978dd5e0d478105b6276ecb2bcadc9fa4b707
d3c826e703903409a9872986b9be88801a6c28027cb8f1a0bda16d9c3bdbf96d
d43032381f5d4fe2cb90a0107c027cabc6fe63e102d21a84bf02ae0b1e9289bd
d4542b2c750ddc48ef799c19992beedb965469683f3ad3c4ecfee120fcf832c5
d5381d2424a621c089d7eb7afae2dff7739fa7e3049f57157c592f63f5433a59
d5e285d22c40b4034bcede19962e2336ceac1953ef8f0a9327ae3cbed9a0ec6a
d60e20e94cb81bc2dc2cc690dbf9594ef8e7351e6cc0e4e9673de7e06b2898c1
d6257db4781e8531fee85c1cd8fe8adf06a6b7763ed73da1906a14d24925fc1d
d71b26459af241c9e1dfd46f88409f2f7b7747d3f0263d13b23f41dc4deb0f84
d72786b5af002842c0e8837438ea0e51c6fcce51a771762e3dae3234a5a0897b
d78e21871d8b6e3f7a3eb72f78f2ea0bb658d7a8549b09a93985356846c15a3c
d7bec36083cf82e29a1a98146518a381e5fce39f3103bc713760943ff321af9f
d82109ca031904db888330a0ab8c8987685e71f8dbff7393792df6d32b4ae712
d8577cc03e19531f291409c9ec30e3383187e05622434cb8b79066db90350d82
d8e6c805d983d78be03b040fd27b637d000d749ef8133d58acb67d17c14cbf2f
d92190e4519a5af2d2693bf9f03568740b4dc46062c3c2dd5aad8dd7394743a8
d97f530e9029d4cd81d233bba60beefe8cdbac5abb0ca9363fd6e57ba6a400f3
d99bc901b1802af0bd898a6327beafccc15295abc9cd9b7a37f66461ac940a7c
da25bc36704e85b7df0251035f3b8de714fcb9a2b1ff874b672939c3063efac1
da4ef29ad2b72e87dfb232418f89799e96070bae83bab194c479fb81577c5362
db7eb212132cf8b09c0ac1aebfd4d908745eceb2821e2b49f5e3ce424d3c9293
dbdecfa27fb8efa344e91328c01fea8cd2110a901a359420dc67c855c664e38f
dbdfde7fe53358e4d135fcf0485ffc425b2b94f13f57afa9728bfb29ad9c40e5
dc06088169d82bfb3bf20fa94566038849b41f0c772ebdf6cc13a92263873a65
dc4d5134c964e004931f093e62245e46181f326f13bb71cd54b9555b835fe7b4
dc846ff97578d505a5483c8827a07556cd43036b9fec6ca286ef00c2eab9bffd
dc88f85d36c8a619076a4eae62f3ead0a10142bd447565ac6d2587a2997c4e9c
dcd030f0b0646a5639cb36765426a6ca7cdeb8168f7116c7448f0abafc5a4931
dd9c572087f92a74232343008a70468eeee08d97112450db549eb0fb33a8d29e
de1afb88215e00b222e1adf79e1e8eb25e90bb945037385b67b48b414b79e0cc
de4c90d2c37524af7fcd7ba71dd26116127061387ebb8942c3790d502e4889f0
df1b34946ffa093c1d55dfe5a7028bf96774ec03dc0d9c90d09203b48752dbfd
df3b193a4f85c590037080c30f47cfcdbf25233523cdbb8afd225ef7b9556ec3
e06dad415bd16954dbcdee69b5f4184b07d17531aa22edd61ef43fa0ffc19bcd
e0a2092139c370f402284efaf452317f36b6cf859e5aadc058eb21b6e63bebeb
e124d3c7a1c35d29a021fb18e415a82acaec0145c49dc3c34c328408d027eba8
e16232133565da1c02ccbe6ab1aa386e795270c664550bcb1e462f4e31ad5ae6
e1c77bcf6c0f4690e88ee18bd465d8d09160c87ff84b4e55a8bcaf74cb1267f7
e1c85f9d7267c0b9bdad89c4702de3383abcc9980280244bd24c8957bb216655
e2a9712716010c54b08d4ec8acc7b78608a80735ef0aa6b2ffac9ca774e810f8
e2aae338d4803f16b4ee3c68163f2312eefe0c9b2a2fdb5ca9532cfd9d7caac7
e36a39c2faefa6eb021c706377df03f66a522536789e03f879217f13f455346d
e3eadb8e405347710f365457977a3886caf1bd44db411f2e7660e4e89ea0e533
e4d34334d1e19820930122c7816c18f12fa68d9d4a2a6d91f53e4567cdb02167
e5943fa049bbbbefd223e5966f442f299861000b5121337ac2d297187420006e
e60143686f94bbff438ca8d1ec28b93f48dab068c458d943110c425586e89f38
e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e
e651765ec94c99c2ea03cf19aceb85785d656ba08685eb0772747c296340cb54
e660e4f62461ca04698fe7a71acfbf6e8d399f91c966099adc619d9c0b0671d9
e6c6ae9594f5eac0613ead2cd2176cf91f031c98c454f7b42103ce0d65bc40ce
e74e439a0e4120562bce4a3f58259e0dcf2088a8442213bca7b0eda2832ad2eb
e8a42affefb8967a820164e26156aed6d9bd512a6d3124b81268b4de552a250d
e8b8d9a97e3de084549b35455b26245209f42176c67ce30ab09e5ad6ef59dbd3
e911b250d03141e6fbfc0564bd0ffaa641b36d0def8ae80127c21add98da2f5d
e989b2fa4a8515f8b29a0f0274aac18a81c6b26b8de0b98c8fdec021c03e34fd
e9b4425a4fbe74fe12739f57a7df5a4b9566eabca341e2a35c9ba951d7501c48
ea9d11ca91c3f81f9f9237acc2a17ea19f5862d64a186d5242f9ddbc343f995d
eac1b63f081439ba1dd7ed03bfdcff40baddb0ec681a08f4f4259cb7187485e9
ebdea9b587b934d0ec46f02c5f7088f957b8c701b754cccae6e7a985f1e65819
ec2379829cfe784f1d1a6a07924cd45a533b72af8f570ef54deed276599f705e
ed972a76701c98056e4db2f0c2c04498d020af4d37c320e1deb8a80a429d04c6
eed107e0fec61f8f41084807334dbca3705d59e476c7f883c7b1e5e0a1cec31e
ef0c2313784560e2e656056a467313f939e073f6512bad4a3d6c108469b876a6
ef335439ca9e34f7e782f4652c24c21d13c1099fc37233c573540078b985bc48
ef8ac24af610d366eb6782dc350def12860ed20c0ccb8441d3fd0d3899373ed7
f0e34c755ce79f8a84e429d2c181826fb18623b042199acf383e29a99c467d4f
f19b121668f1951ecb1047bee02a1ad2b0742ee911a109aae244dda9ad8bf9b4
f26233d864fcbb7a4ed3a159af6348664d7810a96782e986fac79b5a15a4171e
f2784c16508eb5ebce419ee46ab03b8eac1d3d3d9c9dc425bc6d2c92b98d74b6
f28e42ea17d70953a08a344318d3ab00ac73bc9abbf860183a9b39bc7f29e420
f32ab58961e78c7bd6c58d3cee439783daa353b440f1e0af4d2c783bdcb35ead
f3f27e4dd85477b36c849cf9cbe465dba8d8010080fac79ce0533b383ec15046
f450381ab4ce5ebdaa89554d8c62eb093856e5b4a2b80017626bcc2e0aee3bc4
f4abea1bd2b77d4bb037f9db772271d75aef7d1e0a1a731ec3a1e949e9b0be25
f4b8d40d1739674dfeffa83fdf265a38a51a667feaf0821be54d1f2807b6f05a
f52323a2cc58d7632ba0c0efbf667f8467613c018e4962c65004a2912188fa19
f572d6b0df10a4e0c3e1bd6b50d24fc9beedf9cc09de6a67dfb7b3d13d0a85be
f577a36a9646245f5bd78062cb88fe8e5443549393eaaa9925ca81fab0059653
f57dfe6b2efee31dd50aee0b4e4abf6ebef5c367fc22989c9586f979c2aef14c
f5e8212bdbf0465a5196123ad9b72a89f88bba7071a03c91b20f6ca41def6fd6
f797d8bcfec14f42f9eb6fe202623e1ffcbe267e5f375ebc41152fa6035935fd
f87ce2080247c90c746b033c6846bdd1607a24ea93fb234b9c8c8621ba321718
f8ee7ddef53b6788d7fc73f0fac34c10faf8f5843fd1f7eb4d618f5130d8ebf3
f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af
f9ff463d510faf6471dd42310eea0140c8a4bf4396d5a94ce526bf1da57e2393
fa06692b4ef4f18ac54b4a55dcf4e9420dd4d25731eabaaaa4778bcaf14bbc70
fa8eee52cef33c5c1c90a2d4abcc1967d0decd02989a8714e04c9bfeaca3cb29
fa95c7b659d1d423e98b6519650c3c7661ff32829677549ec09a88017a2173e3
fb88fbbbd2e20eeb094fc8b527a1823adcd1b775d0fe2625c3231845e22c0ff5
fbeba36b4c19ff4a85738ee084a1b651a5d6086b7158a6f2d8ef7fee909a6113
fc428d6bc292781b9fd73562f2d3ceae684be2679190b5b6bb7346cb50d4e2dd
fc90b7868ee0ac805d181ecae1f31c7454c0482da39baf2e1d30bc94d72eb4ef
fcb1a0c380058f809b25ca0554186822cecbeb28b5371f0da772f68c251ff826
fcbbf81dc459cbe67fe6ae0da1edb9cbb5e1b0d59f1ff0cc2d084d2c9545b0c7
fcfaca9856c9d06723391332be070f14157dc455699d40c8852a50b70f45fada
fd690ba616f1a75c69b173d958d3840f12e0ac0e59ecc828f93a4961e07ff5e4
fd93c9a443ac94214588705916ba4e225a4dd20dd6e2cc33c1c4efee0b06d035
fde083399cda4879d5304c1a4d2c48d251fc4cecc26dec4a723c17fd018d5ecf
fe6d93c1924e715d2762b6363b22bcf84bf77677d4938e19cb0b7688a4c236df
feebf420fa05a519eae9d7e14c2d812fc4021ecc33b0c7b23a596bcc5ba81d05
ff236b8dab68476f9bac3731c87eff239bcc63db1402d67dcfbf179fcd47d450
ff8f9f8d604b498788e48698201c62da514163db5b2e002c04d90575408fdaea
""",
    "CC0-1.0": """
96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f
""",
    "GPL-1.0": """
6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc
89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70
8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224
""",
    "GPL-2.0": """
6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808
e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34
efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821
""",
    "GPL-3.0": """
092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191
ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636
eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a
""",
    "ISC": """
217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a
23651ce8a73abaa8fad9143faad3fca843b5de6baf345008f65c453ea5685fb1
280d76b420aeff51730e96577a2466120c91213f03dd50d60107078c498c5b29
40e6eb51c3b409d93549806b55b249c261dab149d19b56cc163624f39a08b1db
5456fff23cf44064ff54d9d973cf8a7204e2788759d3d01ba3de38afc4515eee
673f59dc8ad54524704b5b5d2deeb39eec917afad46597b1b7d4f2963edff317
77e9889024ef4c09ad3e65c9c303459fdde03c84e2f9d24ba9d7cebb938ff23a
8281b7122b87e54b97a6183786fef9b33350db9bfb9141855ea93e09543e1fcc
8ee0d4f927294d5cfe44a2a4b1faecb347cc94d0e53edd910b1abc0f6527865f
929ea44171ff3ef7e5d1c64ee12f9422c4d18c944cd72a089a8c58e61f5f984d
a285b2987fbd98096b971c73f42998e424fd3014a9690457259734f639dee8eb
f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee
""",
    "LGPL-2.0": """
430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2
504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260
61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908
""",
    "LGPL-2.1": """
48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4
4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891
bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df
""",
    "LGPL-3.0": """
aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be
""",
    "MIT": """
07a0c98d1dbf0062cedfbb5e38df91d8bd896a09ec198aa53c51fb2115592bd7
0ae6a1449c55564f09306c58e84bcf7429809a582562aa93352d4acfec8c67cf
0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c
35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164
581c58dda46462468177d8af0224930878c4db1747d8d4e21c1067fb0f753199
635c929f7c1c673979f7a2a3db525541620e3eae08ad8d0579bd9a14f662608d
6733127d88b7d3bd59c42da120690dbdff1e658acf3fa3e2448092079ad6999a
6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f
6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127
7215493270b1a538e244610d920058b765e8dd953e16b856c437adc28fc674f8
74620107d78b567f655cb06d51f930a5e0e3cd3e1a2478bc7b860e678d8e447b
7c3366b22b9f0d6a198b2c29bd1c4b663b2d55eacbd066146e5476c4b8ff1ce4
881013c70f6eb494bdd894e8888e4bffdd9457b7ec7a26691e47b4fc209b12dd
cc9960c60fe2db01bf880b0d9973aa8f363261a4bd254759e317e4bcf79cb747
ce56920e57e65aea4988a3d04f523bdceedd62176f0e66860fba85f85433a29b
f6977bef8312da49f220a7043e358dc5a0eabeb03043faa779ca620a540879bd
""",
    "MPL-1.1": """
0b93918765bfa96471883549916c4ce7b68df4d9bc72806c09441a4f5e89e12a
""",
    "MPL-2.0": """
6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d
""",
    "Unlicense": """
0cfb18f044ca63ead68f9d025d49eac3bd40aa6aaa0ba8e5871de6e97e6d90b9
2678c84ccc8704fa7e91cc97b86954081f3a4a03efb2a16c006bcebbe5aa1b64
9fbf62f6784505d4a2c57f60a3f6846fdc75ae86d58d163b430639bc7054eb40
b250fa1cb89ef01ef33d4c69bed96c9ed5bbd802d8264fb5df03218499e86471
e004e218cb49cc5380ae88b74959546d5ffade35d8fa0f2d1fe2c87f91a33b89
e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229
f507d73d343a3d7b0b7ecd39319f6c349b515eeed80b814918af61cdac69e4a5
fc1f640c3081f07200157ecf84866a527c48cd3f1ae37f29a2631e58e7adbc0a
""",
}
