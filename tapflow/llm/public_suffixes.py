"""Public suffixes of two and more labels, from the Public Suffix List.

All rules with a dot of https://publicsuffix.org/list/ (as packaged with Debian),
ICANN and private section; names in other scripts also as punycode. '*.x'
stands for every name right below x, '!y' is an exception from that. The list
is subject to the terms of the Mozilla Public License, v. 2.0
(https://mozilla.org/MPL/2.0/)."""

RULES = """
!city.kawasaki.jp !city.kitakyushu.jp !city.kobe.jp !city.nagoya.jp !city.sapporo.jp !city.sendai.jp !city.yokohama.jp
!www.ck *.0emm.com *.advisor.ws *.alces.network *.awdev.ca *.azurecontainer.io *.backyards.banzaicloud.io
*.banzai.cloud *.bd *.beget.app *.build.run *.builder.code.com *.bzz.dapps.earth *.ck *.cloud.metacentrum.cz
*.cloudera.site *.cns.joyent.com *.code.run *.compute-1.amazonaws.com *.compute.amazonaws.com
*.compute.amazonaws.com.cn *.compute.estate *.cryptonomic.net *.customer-oci.com *.dapps.earth *.database.run
*.dev-builder.code.com *.dev.adobeaemcloud.com *.devcdnaccesso.com *.developer.app *.digitaloceanspaces.com
*.diher.solutions *.dweb.link *.elb.amazonaws.com *.elb.amazonaws.com.cn *.er *.ex.futurecms.at *.ex.ortsinfo.at
*.firenet.ch *.fk *.frusky.de *.futurecms.at *.gateway.dev *.hosting.myjino.ru *.hosting.ovh.net *.in.futurecms.at
*.jm *.kawasaki.jp *.kh *.kitakyushu.jp *.kobe.jp *.kunden.ortsinfo.at *.landing.myjino.ru *.lcl.dev *.lclstage.dev
*.linodeobjects.com *.magentosite.cloud *.migration.run *.mm *.moonscale.io *.nagoya.jp *.nodebalancer.linode.com
*.nom.br *.northflank.app *.np *.oci.customer-oci.com *.ocp.customer-oci.com *.ocs.customer-oci.com *.on-acorn.io
*.on-k3s.io *.on-rancher.cloud *.on-rio.io *.otap.co *.owo.codes *.paywhirl.com *.pg *.platformsh.site
*.quipelements.com *.r.appspot.com *.rss.my.id *.s5y.io *.sapporo.jp *.sch.uk *.sendai.jp *.sensiosite.cloud
*.spectrum.myjino.ru *.statics.cloud *.stg-builder.code.com *.stg.dev *.stgstage.dev *.stolos.io *.svc.firenet.ch
*.sys.qcx.io *.telebit.xyz *.transurl.be *.transurl.eu *.transurl.nl *.triton.zone *.tst.site *.uberspace.de *.user.fm
*.user.localcert.dev *.usercontent.goog *.vps.myjino.ru *.vultrobjects.com *.webhare.dev *.webpaas.ovh.net
*.yokohama.jp 0.bg 001www.com 0e.vc 1.azurestaticapps.net 1.bg 123hjemmeside.dk 123hjemmeside.no 123homepage.it
123kotisivu.fi 123minsida.se 123miweb.es 123paginaweb.pt 123sait.ru 123siteweb.fr 123webseite.at 123webseite.de
123website.be 123website.ch 123website.lu 123website.nl 12hp.at 12hp.ch 12hp.de 1337.pictures 16-b.it 1kapp.com
2.azurestaticapps.net 2.bg 2000.hu 2038.io 2ix.at 2ix.ch 2ix.de 3.bg 32-b.it 3utilities.com 4.bg 4lima.at 4lima.ch
4lima.de 4u.com 5.bg 5g.in 6.bg 611.to 64-b.it 6g.in 7.bg 8.bg 9.bg 9guacu.br a.bg a.prod.fastly.net a.run.app a.se
a.ssl.fastly.net aa.no aaa.pro aarborte.no ab.ca abashiri.hokkaido.jp abc.br abeno.osaka.jp abiko.chiba.jp
abira.hokkaido.jp abkhazia.su abo.pa abr.it abruzzo.it abu.yamaguchi.jp ac.ae ac.at ac.be ac.ci ac.cn ac.cr ac.cy
ac.fj ac.gn ac.gov.br ac.id ac.il ac.im ac.in ac.ir ac.jp ac.ke ac.kr ac.leg.br ac.lk ac.ls ac.ma ac.me ac.mu ac.mw
ac.mz ac.ni ac.nz ac.pa ac.pr ac.rs ac.ru ac.rw ac.se ac.sz ac.th ac.tj ac.tz ac.ug ac.uk ac.vn ac.za ac.zm ac.zw
aca.pro academia.bo academy.museum accesscam.org accident-investigation.aero accident-prevention.aero acct.pro
achi.nagano.jp act.au act.edu.au activetrail.biz ad.jp adachi.tokyo.jp adimo.co.uk adm.br adobeaemcloud.com
adobeaemcloud.net adobeio-static.net adobeioruntime.net adult.ht adv.br adv.mz adygeya.ru adygeya.su ae.org aejrie.no
aero.mv aero.tt aerobatic.aero aeroclub.aero aerodrome.aero aeroport.fr affinitylottery.org.uk afjord.no africa.bj
africa.com ag.it aga.niigata.jp agano.niigata.jp agdenes.no agematsu.nagano.jp agents.aero agr.br agrar.hu agric.za
agriculture.museum agrigento.it agro.bj agro.bo agro.pl aguni.okinawa.jp ah.cn ah.no ai.in aibetsu.hokkaido.jp
aichi.jp aid.pl aikawa.kanagawa.jp ainan.ehime.jp aioi.hyogo.jp aip.ee air-surveillance.aero air-traffic-control.aero
air.museum aircraft.aero airguard.museum airkitapps-au.com airkitapps.com airkitapps.eu airline.aero airport.aero
airtraffic.aero aisai.aichi.jp aisho.shiga.jp aivencloud.com aizubange.fukushima.jp aizumi.tokushima.jp
aizumisato.fukushima.jp aizuwakamatsu.fukushima.jp aju.br ak.us akabira.hokkaido.jp akadns.net akagi.shimane.jp
akaiwa.okayama.jp akamai-staging.net akamai.net akamaiedge-staging.net akamaiedge.net akamaihd-staging.net
akamaihd.net akamaiorigin-staging.net akamaiorigin.net akamaized-staging.net akamaized.net akashi.hyogo.jp
aki.kochi.jp akiruno.tokyo.jp akishima.tokyo.jp akita.akita.jp akita.jp akkeshi.hokkaido.jp aknoluokta.no ako.hyogo.jp
akrehamn.no aktyubinsk.su akune.kagoshima.jp al.eu.org al.gov.br al.it al.leg.br al.no al.us alabama.museum
alaheadju.no aland.fi alaska.museum alessandria.it alesund.no algard.no alp1.ae.flow.ch alpha-myqnapcloud.com
alpha.bounty-full.com alstahaug.no alt.za alta.no altervista.org alto-adige.it altoadige.it alvdal.no alwaysdata.net
am.br am.gov.br am.in am.leg.br ama.aichi.jp ama.shimane.jp amagasaki.hyogo.jp amakusa.kumamoto.jp amami.kagoshima.jp
amber.museum ambulance.aero ambulance.museum american.museum americana.museum americanantiques.museum
americanart.museum ami.ibaraki.jp amli.no amot.no amscompute.com amsterdam.museum amusement.aero an.it
anamizu.ishikawa.jp anan.nagano.jp anan.tokushima.jp anani.br ancona.it and.museum andasuolo.no andebu.no ando.nara.jp
andoy.no andria-barletta-trani.it andria-trani-barletta.it andriabarlettatrani.it andriatranibarletta.it andøy.no
angry.jp anjo.aichi.jp ann-arbor.mi.us annaka.gunma.jp annefrank.museum anpachi.gifu.jp anthro.museum
anthropology.museum antiques.museum ao.it aogaki.hyogo.jp aogashima.tokyo.jp aoki.nagano.jp aomori.aomori.jp aomori.jp
aosta-valley.it aosta.it aostavalley.it aoste.it ap-northeast-1.elasticbeanstalk.com
ap-northeast-2.elasticbeanstalk.com ap-northeast-3.elasticbeanstalk.com ap-south-1.elasticbeanstalk.com
ap-southeast-1.elasticbeanstalk.com ap-southeast-2.elasticbeanstalk.com ap.gov.br ap.gov.pl ap.it ap.leg.br
aparecida.br api.gov.uk api.stdlib.com apigee.io app.banzaicloud.io app.br app.gp app.lmpm.com
app.os.fedoraproject.org app.os.stg.fedoraproject.org app.render.com appchizi.com appengine.flow.ch applinzi.com
apps.fbsbx.com apps.lair.io appspacehosted.com appspaceusercontent.com appspot.com appudo.net aq.it aquarium.museum
aquila.it ar.com ar.it ar.us arai.shizuoka.jp arakawa.saitama.jp arakawa.tokyo.jp arao.kumamoto.jp arboretum.museum
archaeological.museum archaeology.museum architectes.bj architecture.museum ardal.no aremark.no arendal.no arezzo.it
ariake.saga.jp arida.wakayama.jp aridagawa.wakayama.jp arita.saga.jp arkhangelsk.su armenia.su arna.no arq.br art.br
art.do art.dz art.ht art.museum art.pl art.sn artanddesign.museum artcenter.museum artdeco.museum arte.bo
arteducation.museum artgallery.museum arts.co arts.museum arts.nf arts.ro arts.ve artsandcrafts.museum arvo.network
as.us asago.hyogo.jp asahi.chiba.jp asahi.ibaraki.jp asahi.mie.jp asahi.nagano.jp asahi.toyama.jp asahi.yamagata.jp
asahikawa.hokkaido.jp asaka.saitama.jp asakawa.fukushima.jp asakuchi.okayama.jp asaminami.hiroshima.jp
ascoli-piceno.it ascolipiceno.it aseral.no ashgabad.su ashibetsu.hokkaido.jp ashikaga.tochigi.jp ashiya.fukuoka.jp
ashiya.hyogo.jp ashoro.hokkaido.jp asker.no askim.no askoy.no askvoll.no askøy.no asmatart.museum asn.au asn.lv
asnes.no aso.kumamoto.jp ass.km assabu.hokkaido.jp assassination.museum assisi.museum assn.lk asso.ci asso.dz
asso.eu.org asso.fr asso.gp asso.ht asso.km asso.mc asso.nc asso.re association.aero association.museum assur.bj
asti.it astronomy.museum asuke.aichi.jp at-band-camp.net at.eu.org at.it at.md at.vg atami.shizuoka.jp ath.cx
atl.jelastic.vps-host.net atlanta.museum atm.pl ato.br atsugi.kanagawa.jp atsuma.hokkaido.jp au.eu.org audnedaln.no
augustow.pl aukra.no aure.no aurland.no aurskog-holand.no aurskog-høland.no aus.basketball austevoll.no austin.museum
australia.museum austrheim.no authgear-staging.com authgearapps.com author.aero auto.pl autocode.dev automotive.museum
av.it av.tr avellino.it averoy.no averøy.no aviation.museum avocat.fr avocat.pro avocats.bj avoues.fr awaji.hyogo.jp
awsglobalaccelerator.com awsmppl.com axis.museum aya.miyazaki.jp ayabe.kyoto.jp ayagawa.kagawa.jp ayase.kanagawa.jp
az.us azerbaijan.su azimuth.network azumino.nagano.jp azure-mobile.net azurestaticapps.net azurewebsites.net
aéroport.ci b-data.io b.bg b.br b.se b.ssl.fastly.net ba.gov.br ba.it ba.leg.br babia-gora.pl babyblue.jp babymilk.jp
backdrop.jp backplaneapp.io badaddja.no badajoz.museum baghdad.museum bahcavuotna.no bahccavuotna.no bahn.museum
baidar.no bajddar.no balashov.su balat.no bale.museum balena-devices.com balestrand.no ballangen.no ballooning.aero
balsan-sudtirol.it balsan-suedtirol.it balsan-südtirol.it balsan.it balsfjord.no baltimore.museum bambina.jp bamble.no
bandai.fukushima.jp bando.ibaraki.jp bar.pro bar0.net bar1.net bar2.net barcelona.museum bardu.no bari.it
barletta-trani-andria.it barlettatraniandria.it barrel-of-knowledge.info barrell-of-knowledge.info barsy.bg barsy.ca
barsy.club barsy.co.uk barsy.de barsy.eu barsy.in barsy.info barsy.io barsy.me barsy.menu barsy.mobi barsy.net
barsy.online barsy.org barsy.pro barsy.pub barsy.ro barsy.shop barsy.site barsy.support barsy.uk barsycenter.com
barsyonline.co.uk barsyonline.com barueri.br barum.no bas.it base.ec base.shop baseball.museum basel.museum
bashkiria.ru bashkiria.su basicserver.io basilicata.it baths.museum bato.tochigi.jp batsfjord.no bauern.museum bbs.tr
bc.ca bc.platform.sh bci.dnstrace.pro bd.se be.ax be.eu.org be.gy beagleboard.io bearalvahki.no bearalváhki.no
beardu.no beauxarts.museum bedzin.pl beeldengeluid.museum beep.pl beiarn.no bel.tr belau.pw belem.br bellevue.museum
belluno.it benevento.it beppu.oita.jp berg.no bergamo.it bergbau.museum bergen.no berkeley.museum berlevag.no
berlevåg.no berlin.museum bern.museum beskidy.pl bet.ar beta.bounty-full.com beta.tailscale.net betainabox.com
better-than.tv bg.eu.org bg.it bhz.br bi.it bialowieza.pl bialystok.pl bib.br bib.ve bibai.hokkaido.jp bible.museum
biei.hokkaido.jp bielawa.pl biella.it bieszczady.pl bievat.no bievát.no bifuka.hokkaido.jp bihar.in bihoro.hokkaido.jp
bilbao.museum bill.museum bindal.no bio.br bip.sh bir.ru biratori.hokkaido.jp birdart.museum birkenes.no
birthplace.museum bitbridge.net bitbucket.io bitter.jp biz.at biz.az biz.bb biz.cy biz.dk biz.et biz.fj biz.gl biz.id
biz.in biz.ki biz.ls biz.mv biz.mw biz.my biz.ni biz.nr biz.pk biz.pl biz.pr biz.ss biz.tj biz.tr biz.tt biz.ua biz.vn
biz.wf biz.zm bizen.okayama.jp bj.cn bjarkoy.no bjarkøy.no bjerkreim.no bjugn.no bl.it blackbaudcdn.net blog.bo
blog.br blog.gt blog.kg blog.vu blogdns.com blogdns.net blogdns.org blogsite.org blogsite.xyz blogspot.ae blogspot.al
blogspot.am blogspot.ba blogspot.be blogspot.bg blogspot.bj blogspot.ca blogspot.cf blogspot.ch blogspot.cl
blogspot.co.at blogspot.co.id blogspot.co.il blogspot.co.ke blogspot.co.nz blogspot.co.uk blogspot.co.za blogspot.com
blogspot.com.ar blogspot.com.au blogspot.com.br blogspot.com.by blogspot.com.co blogspot.com.cy blogspot.com.ee
blogspot.com.eg blogspot.com.es blogspot.com.mt blogspot.com.ng blogspot.com.tr blogspot.com.uy blogspot.cv
blogspot.cz blogspot.de blogspot.dk blogspot.fi blogspot.fr blogspot.gr blogspot.hk blogspot.hr blogspot.hu
blogspot.ie blogspot.in blogspot.is blogspot.it blogspot.jp blogspot.kr blogspot.li blogspot.lt blogspot.lu
blogspot.md blogspot.mk blogspot.mr blogspot.mx blogspot.my blogspot.nl blogspot.no blogspot.pe blogspot.pt
blogspot.qa blogspot.re blogspot.ro blogspot.rs blogspot.ru blogspot.se blogspot.sg blogspot.si blogspot.sk
blogspot.sn blogspot.td blogspot.tw blogspot.ug blogspot.vn blogsyte.com bloxcms.com bluebite.io blush.jp bmd.br
bmoattachments.org bn.it bnr.la bo.it bo.nordland.no bo.telemark.no boavista.br bodo.no bodø.no bokn.no
boldlygoingnowhere.org boleslawiec.pl bolivia.bo bologna.it bolt.hu bolzano-altoadige.it bolzano.it bomlo.no
bonn.museum boo.jp bookonline.app boomla.net boston.museum botanical.museum botanicalgarden.museum
botanicgarden.museum botany.museum bounceme.net bounty-full.com boutir.com boxfuse.io boy.jp boyfriend.jp
bozen-sudtirol.it bozen-suedtirol.it bozen-südtirol.it bozen.it bplaced.com bplaced.de bplaced.net br.com br.it
brand.se brandywinevalley.museum brasil.museum brasilia.me bremanger.no brescia.it brindisi.it bristol.museum
british.museum britishcolumbia.museum broadcast.museum broke-it.net broker.aero bronnoy.no bronnoysund.no
browsersafetymark.io brumunddal.no brunel.museum brussel.museum brussels.museum bruxelles.museum bryansk.su bryne.no
brønnøy.no brønnøysund.no bs.it bsb.br bss.design bt.it bu.no budejju.no building.museum builtwithdark.com bukhara.su
bulsan-sudtirol.it bulsan-suedtirol.it bulsan-südtirol.it bulsan.it bungoono.oita.jp bungotakada.oita.jp
bunkyo.tokyo.jp burghof.museum bus.museum busan.kr bushey.museum business.in but.jp buyshop.jp buyshouses.net
buzen.fukuoka.jp bydgoszcz.pl byen.site bygland.no bykle.no bytom.pl bz.it báhcavuotna.no báhccavuotna.no báidár.no
bájddar.no bálát.no bådåddjå.no båtsfjord.no bærum.no bø.nordland.no bø.telemark.no bømlo.no c.bg c.cdn77.org c.la
c.se c66.me ca-central-1.elasticbeanstalk.com ca.eu.org ca.in ca.it ca.na ca.reclaim.cloud ca.us caa.aero caa.li
cable-modem.org cadaques.museum cafjs.com cagliari.it cahcesuolo.no cal.it calabria.it california.museum
caltanissetta.it cam.it cambridge.museum camdvr.org campaign.gov.uk campania.it campidano-medio.it campidanomedio.it
campinagrande.br campinas.br campobasso.it can.museum canada.museum candypop.jp canva-apps.cn canva-apps.com
capebreton.museum capoo.jp caracal.mythic-beasts.com carbonia-iglesias.it carboniaiglesias.it cargo.aero
carrara-massa.it carraramassa.it carrd.co carrier.museum cartoonart.museum casacam.net casadelamoneda.museum
caserta.it casino.hu castle.museum castres.museum cat.ax catania.it catanzaro.it catering.aero catfood.jp
catholic.edu.au caxias.br cb.it cbg.ru cc.ak.us cc.al.us cc.ar.us cc.as.us cc.az.us cc.ca.us cc.co.us cc.ct.us
cc.dc.us cc.de.us cc.fl.us cc.ga.us cc.gu.us cc.hi.us cc.hn cc.ia.us cc.id.us cc.il.us cc.in.us cc.ks.us cc.ky.us
cc.la.us cc.ma.us cc.md.us cc.me.us cc.mi.us cc.mn.us cc.mo.us cc.ms.us cc.mt.us cc.na cc.nc.us cc.nd.us cc.ne.us
cc.nh.us cc.nj.us cc.nm.us cc.nv.us cc.ny.us cc.oh.us cc.ok.us cc.or.us cc.pa.us cc.pr.us cc.ri.us cc.sc.us cc.sd.us
cc.tn.us cc.tx.us cc.ua cc.ut.us cc.va.us cc.vi.us cc.vt.us cc.wa.us cc.wi.us cc.wv.us cc.wy.us cci.fr cd.eu.org
cdn-edges.net cdn.prod.atlassian-dev.net cdn77-ssl.net ce.gov.br ce.it ce.leg.br cechire.com celtic.museum
center.museum centralus.azurestaticapps.net certification.aero certmgr.org cesena-forli.it cesena-forlì.it
cesenaforli.it cesenaforlì.it cf-ipfs.com ch.eu.org ch.it ch.tc ch.trendhosting.cloud chambagri.fr championship.aero
channelsdvr.net charter.aero chattanooga.museum cheap.jp cheltenham.museum cherkassy.ua cherkasy.ua chernigov.ua
chernihiv.ua chernivtsi.ua chernovtsy.ua chesapeakebay.museum chiba.jp chicago.museum chicappa.jp chichibu.saitama.jp
chieti.it chigasaki.kanagawa.jp chihayaakasaka.osaka.jp chijiwa.nagasaki.jp chikugo.fukuoka.jp chikuho.fukuoka.jp
chikuhoku.nagano.jp chikujo.fukuoka.jp chikuma.nagano.jp chikusei.ibaraki.jp chikushino.fukuoka.jp chikuzen.fukuoka.jp
children.museum childrens.museum childrensgarden.museum chillout.jp chimkent.su chino.nagano.jp
chippubetsu.hokkaido.jp chips.jp chiropractic.museum chirurgiens-dentistes-en-france.fr chirurgiens-dentistes.fr
chiryu.aichi.jp chita.aichi.jp chitose.hokkaido.jp chiyoda.gunma.jp chiyoda.tokyo.jp chizu.tottori.jp chocolate.museum
chofu.tokyo.jp chonan.chiba.jp chosei.chiba.jp choshi.chiba.jp chowder.jp choyo.kumamoto.jp christiansburg.museum
chtr.k12.ma.us chu.jp chungbuk.kr chungnam.kr chuo.chiba.jp chuo.fukuoka.jp chuo.osaka.jp chuo.tokyo.jp
chuo.yamanashi.jp ci.it ciao.jp ciencia.bo cieszyn.pl cim.br cincinnati.museum cinema.museum circus.museum
ciscofreak.com cistron.nl city.hu civilaviation.aero civilisation.museum civilization.museum civilwar.museum ck.ua
cl.it clan.rip clerk.app clerkstage.app cleverapps.io clicketcloud.com clickrising.net clinton.museum clock.museum
cloud-fr1.unispace.io cloud.fedoraproject.org cloud.goog cloud.interhostsolutions.be cloud.jelastic.open.tim.it
cloud.nospamproxy.com cloud66.ws cloud66.zone cloudaccess.host cloudaccess.net cloudapp.net cloudapps.digital
cloudcontrolapp.com cloudcontrolled.com cloudflare-ipfs.com cloudfront.net cloudfunctions.net cloudjiffy.net
cloudns.asia cloudns.biz cloudns.cc cloudns.club cloudns.eu cloudns.in cloudns.info cloudns.org cloudns.pro cloudns.pw
cloudns.us cloudsite.builders cloudycluster.net club.aero club.tw cn-north-1.eb.amazonaws.com.cn
cn-northwest-1.eb.amazonaws.com.cn cn.com cn.eu.org cn.in cn.it cn.ua cn.vu cng.br cnpy.gdn cnt.br co.ae co.ag co.am
co.ao co.at co.bb co.bi co.bj co.bn co.business co.bw co.ca co.ci co.cl co.cm co.com co.cr co.cz co.dk co.education
co.events co.financial co.gg co.gl co.gy co.hu co.id co.il co.im co.in co.ir co.it co.je co.jp co.ke co.kr co.krd
co.lc co.ls co.ma co.me co.mg co.mu co.mw co.mz co.na co.network co.ni co.nl co.no co.nz co.om co.pl co.place co.pn
co.pw co.ro co.rs co.rw co.st co.sz co.technology co.th co.tj co.tm co.tt co.tz co.ua co.ug co.uk co.us co.uz co.ve
co.vi co.za co.zm co.zw coal.museum coastaldefence.museum cocotte.jp codeberg.page codespot.com cody.museum cog.mi.us
col.ng coldwar.museum collection.museum collegefan.org colonialwilliamsburg.museum coloradoplateau.museum
columbia.museum columbus.museum com.ac com.af com.ag com.ai com.al com.am com.ar com.au com.aw com.az com.ba com.bb
com.bh com.bi com.bj com.bm com.bn com.bo com.br com.bs com.bt com.by com.bz com.ci com.cm com.cn com.co com.cu com.cv
com.cw com.cy com.de com.dm com.do com.dz com.ec com.ee com.eg com.es com.et com.fj com.fm com.fr com.ge com.gh com.gi
com.gl com.gn com.gp com.gr com.gt com.gu com.gy com.hk com.hn com.hr com.ht com.im com.in com.io com.iq com.is com.jo
com.kg com.ki com.km com.kp com.kw com.ky com.kz com.la com.lb com.lc com.lk com.lr com.lv com.ly com.mg com.mk com.ml
com.mo com.ms com.mt com.mu com.mv com.mw com.mx com.my com.na com.nf com.ng com.ni com.nr com.om com.pa com.pe com.pf
com.ph com.pk com.pl com.pr com.ps com.pt com.py com.qa com.re com.ro com.ru com.sa com.sb com.sc com.sd com.se com.sg
com.sh com.sl com.sn com.so com.ss com.st com.sv com.sy com.tj com.tm com.tn com.to com.tr com.tt com.tw com.ua com.ug
com.uy com.uz com.vc com.ve com.vi com.vn com.vu com.ws com.ye com.zm commune.am communication.museum
communications.museum community-pro.de community-pro.net community.museum como.it computer.museum
computerhistory.museum comunicações.museum conf.au conf.lv conf.se conference.aero conn.uk consulado.st
consultant.aero consulting.aero contagem.br contemporary.museum contemporaryart.museum control.aero convent.museum
coolblog.jp coop.ar coop.br coop.ht coop.in coop.km coop.mv coop.mw coop.py coop.rw coop.tt cooperativa.bo
copenhagen.museum copro.uk corporation.museum correios-e-telecomunicações.museum corvette.museum cosenza.it
costume.museum couchpotatofries.org council.aero countryestate.museum county.museum coz.br cpa.pro cq.cn cr.it cr.ua
crafting.xyz crafts.museum cranbrook.museum cranky.jp crd.co creation.museum cremona.it crew.aero cri.br cri.nz
crimea.ua crotone.it cs.in cs.it cs.keliweb.cloud csx.cc ct.it ct.us cuiaba.br cultural.museum culturalcenter.museum
culture.museum cuneo.it cupcake.is curitiba.br curv.dev cust.dev.thingdust.io cust.disrec.thingdust.io
cust.prod.thingdust.io cust.retrosnub.co.uk cust.testing.thingdust.io custom.metacentrum.cz customer.mythic-beasts.com
customer.speedpartner.de cutegirl.jp cv.ua cx.ua cy.eu.org cya.gg cyber.museum cymru.museum cyon.link cyon.site
cz.eu.org cz.it czeladz.pl czest.pl d.bg d.gv.vc d.se daa.jp daegu.kr daejeon.kr daemon.panel.gg dagestan.ru
dagestan.su daigo.ibaraki.jp daisen.akita.jp daito.osaka.jp daiwa.hiroshima.jp dali.museum dallas.museum
damnserver.com daplie.me database.museum date.fukushima.jp date.hokkaido.jp dattolocal.com dattolocal.net
dattorelay.com dattoweb.com davvenjarga.no davvenjárga.no davvesiida.no dazaifu.fukuoka.jp dc.us dd-dns.de ddns.me
ddns.net ddns5.com ddnsfree.com ddnsgeek.com ddnsking.com ddnslive.com ddnss.de ddnss.org ddr.museum de.com de.cool
de.eu.org de.gt de.ls de.md de.trendhosting.cloud de.us deatnu.no debian.net deca.jp deci.jp decorativearts.museum
dedibox.fr dedyn.io def.br definima.io definima.net delaware.museum delhi.in dell-ogliastra.it dellogliastra.it
delmenhorst.museum demo.datacenter.fi demo.datadetect.com demo.jelastic.com democracia.bo demon.nl denmark.museum
deno-staging.dev deno.dev dep.no deporte.bo depot.museum des.br desa.id design.aero design.museum det.br deta.app
deta.dev detroit.museum dev-myqnapcloud.com dev.br dev.static.land dev.vu development.run devices.resinstaging.io
df.gov.br df.leg.br dgca.aero dh.bytemark.co.uk diadem.cloud dielddanuorri.no digick.jp dinosaur.museum
direct.quickconnect.cn direct.quickconnect.to discordsays.com discordsez.com discourse.group discourse.team
discovery.museum diskstation.eu diskstation.me diskstation.org diskussionsbereich.de ditchyourip.com divtasvuodna.no
divttasvuotna.no dk.eu.org dlugoleka.pl dn.ua dnepropetrovsk.ua dni.us dnipropetrovsk.ua dnsalias.com dnsalias.net
dnsalias.org dnsdojo.com dnsdojo.net dnsdojo.org dnsfor.me dnshome.de dnsiskinky.com dnsking.ch dnsup.net
dnsupdate.info dnsupdater.de does-it.net doesntexist.com doesntexist.org dolls.museum donetsk.ua donna.no
donostia.museum dontexist.com dontexist.net dontexist.org doomdns.com doomdns.org dopaas.com doshi.yamanashi.jp
dovre.no dp.ua dr.in dr.na dr.tr drammen.no drangedal.no dray-dns.de drayddns.com draydns.de dreamhosters.com
drobak.no drr.ac drud.io drud.us drøbak.no dscloud.biz dscloud.me dscloud.mobi dsmynas.com dsmynas.net dsmynas.org
dst.mi.us duckdns.org durham.museum dvrcam.info dvrdns.org dy.fi dyn-berlin.de dyn-ip24.de dyn-o-saur.com dyn-vpn.de
dyn.cosidns.de dyn.ddnss.de dyn.home-webserver.de dyn53.io dynalias.com dynalias.net dynalias.org dynamic-dns.info
dynamisches-dns.de dynathome.net dyndns-at-home.com dyndns-at-work.com dyndns-blog.com dyndns-free.com dyndns-home.com
dyndns-ip.com dyndns-mail.com dyndns-office.com dyndns-pics.com dyndns-remote.com dyndns-server.com dyndns-web.com
dyndns-wiki.com dyndns-work.com dyndns.biz dyndns.dappnode.io dyndns.ddnss.de dyndns.info dyndns.org dyndns.tv
dyndns.ws dyndns1.de dynns.com dynserv.org dynu.net dynv6.net dynvpn.de dyroy.no dyrøy.no dønna.no e.bg e.se e12.ve
e164.arpa e4.cz east-kazakhstan.su eastafrica.museum eastasia.azurestaticapps.net eastcoast.museum
eastus2.azurestaticapps.net easypanel.app easypanel.host eating-organic.net eaton.mi.us ebetsu.hokkaido.jp
ebina.kanagawa.jp ebino.miyazaki.jp ebiz.tw echizen.fukui.jp ecn.br eco.bj eco.br ecologia.bo ecommerce-shop.pl
econo.bj economia.bo ed.ao ed.ci ed.cr ed.jp ed.pw edgeapp.net edgecompute.app edgekey-staging.net edgekey.net
edgestack.me edgesuite-staging.net edgesuite.net editorx.io edogawa.tokyo.jp edu.ac edu.af edu.al edu.ar edu.au edu.az
edu.ba edu.bb edu.bh edu.bi edu.bj edu.bm edu.bn edu.bo edu.br edu.bs edu.bt edu.bz edu.ci edu.cn edu.co edu.cu edu.cv
edu.cw edu.dm edu.do edu.dz edu.ec edu.ee edu.eg edu.es edu.et edu.eu.org edu.fm edu.gd edu.ge edu.gh edu.gi edu.gl
edu.gn edu.gp edu.gr edu.gt edu.gu edu.gy edu.hk edu.hn edu.ht edu.in edu.iq edu.is edu.it edu.jo edu.kg edu.ki edu.km
edu.kn edu.kp edu.krd edu.kw edu.ky edu.kz edu.la edu.lb edu.lc edu.lk edu.lr edu.ls edu.lv edu.ly edu.me edu.mg
edu.mk edu.ml edu.mn edu.mo edu.ms edu.mt edu.mv edu.mw edu.mx edu.my edu.mz edu.ng edu.ni edu.nr edu.om edu.pa edu.pe
edu.pf edu.ph edu.pk edu.pl edu.pn edu.pr edu.ps edu.pt edu.py edu.qa edu.rs edu.ru edu.sa edu.sb edu.sc edu.scot
edu.sd edu.sg edu.sl edu.sn edu.so edu.ss edu.st edu.sv edu.sy edu.tj edu.tm edu.to edu.tr edu.tt edu.tw edu.ua edu.uy
edu.vc edu.ve edu.vn edu.vu edu.ws edu.ye edu.za edu.zm education.museum educational.museum educator.aero edugit.io
ee.eu.org eero-stage.online eero.online egersund.no egoism.jp egyptian.museum ehime.jp eid.no eidfjord.no eidsberg.no
eidskog.no eidsvoll.no eigersund.no eiheiji.fukui.jp eisenbahn.museum ekloges.cy elasticbeanstalk.com elblag.pl
elburg.museum elementor.cloud elementor.cool elk.pl elvendrell.museum elverum.no emb.kw embaixada.st
embetsu.hokkaido.jp embroidery.museum emergency.aero emilia-romagna.it emiliaromagna.it emp.br empresa.bo emr.it
en-root.fr en.it ena.gifu.jp encoreapi.com encr.app encyclopedic.museum endofinternet.net endofinternet.org
endoftheinternet.org enebakk.no enf.br eng.br eng.pro engerdal.no engine.aero engineer.aero england.museum
eniwa.hokkaido.jp enna.it ens.tn enscaled.sg ent.platform.sh enterprisecloud.nu entertainment.aero entomology.museum
environment.museum environmentalconservation.museum epilepsy.museum equipment.aero er.in erimo.hokkaido.jp erotica.hu
erotika.hu es-1.axarnet.cloud es.ax es.eu.org es.gov.br es.kr es.leg.br esan.hokkaido.jp esashi.hokkaido.jp esp.br
essex.museum est-a-la-maison.com est-a-la-masion.com est-le-patron.com est-mon-blogueur.com est.pr estate.museum
etajima.hiroshima.jp etc.br ethnology.museum eti.br etne.no etnedal.no eu-1.evennode.com eu-2.evennode.com
eu-3.evennode.com eu-4.evennode.com eu-central-1.elasticbeanstalk.com eu-west-1.elasticbeanstalk.com
eu-west-2.elasticbeanstalk.com eu-west-3.elasticbeanstalk.com eu.ax eu.com eu.encoway.cloud eu.int eu.meteorapp.com
eu.org eu.platform.sh eu.pythonanywhere.com eun.eg eurodir.ru evenassi.no evenes.no evenášši.no evje-og-hornnes.no
exchange.aero exeter.museum exhibition.museum exnet.su experts-comptables.fr express.aero ezproxy.kuleuven.be f.bg
f.se fakefur.jp fam.pk family.museum familyds.com familyds.net familyds.org fantasyleague.cc far.br farm.museum
farmequipment.museum farmers.museum farmstead.museum farsund.no fashionstore.jp fastly-edge.com fastly-terrarium.com
fastlylb.net faststacks.net fastvps-server.com fastvps.host fastvps.site fauske.no fbx-os.fr fbxos.fr fc.it fe.it
fed.us federation.aero fedje.no fedorainfracloud.org fedorapeople.org feira.br fem.jp fentiger.mythic-beasts.com
fermo.it ferrara.it feste-ip.net fet.no fetsund.no fg.it fh-muenster.io fh.se fhs.no fhsk.se fhv.se
fi.cloudplatform.fi fi.cr fi.eu.org fi.it fie.ee field.museum figueres.museum filatelia.museum filegear-au.me
filegear-de.me filegear-gb.me filegear-ie.me filegear-jp.me filegear-sg.me filegear.me film.hu film.museum fin.ci
fin.ec fin.tn fineart.museum finearts.museum finland.museum finnoy.no finnøy.no firebaseapp.com firenze.it
firewall-gateway.com firewall-gateway.de firewall-gateway.net firewalledreplit.co fireweb.app firm.co firm.dk firm.ht
firm.in firm.nf firm.ng firm.ro firm.ve fitjar.no fj.cn fjaler.no fjell.no fl.us fla.no flakstad.no flanders.museum
flap.id flatanger.no fldrv.com flekkefjord.no flesberg.no flier.jp flight.aero flog.br floppy.jp flora.no florence.it
florida.museum floripa.br floro.no florø.no flt.cloud.muni.cz fly.dev flynnhosting.net flå.no fm.br fm.it fm.no
fnc.fr-par.scw.cloud fnd.br fnwk.site foggia.it folionetwork.site folkebibl.no folldal.no fool.jp for-better.biz
for-more.biz for-our.info for-some.biz for-the.biz force.museum forde.no forgeblocks.com forgot.her.name
forgot.his.name forli-cesena.it forlicesena.it forlì-cesena.it forlìcesena.it forsand.no fortal.br forte.id
fortmissoula.museum fortworth.museum forum.hu forumz.info fosnes.no fot.br foundation.museum foz.br
fr-1.paas.massivegrid.net fr-par-1.baremetal.scw.cloud fr-par-2.baremetal.scw.cloud fr.eu.org fr.it
fra1-de.cloudjiffy.net framer.app framer.media framer.photos framer.website framer.wiki framercanvas.com frana.no
francaise.museum frankfurt.museum franziskaner.museum fredrikstad.no free.hr freebox-os.com freebox-os.fr
freeboxos.com freeboxos.fr freeddns.org freeddns.us freedesktop.org freemasonry.museum freemyip.com freesite.host
freetls.fastly.net frei.no freiburg.museum frenchkiss.jp fribourg.museum friuli-v-giulia.it friuli-ve-giulia.it
friuli-vegiulia.it friuli-venezia-giulia.it friuli-veneziagiulia.it friuli-vgiulia.it friuliv-giulia.it
friulive-giulia.it friulivegiulia.it friulivenezia-giulia.it friuliveneziagiulia.it friulivgiulia.it frog.museum
frogn.no froland.no from-ak.com from-al.com from-ar.com from-az.net from-ca.com from-co.net from-ct.com from-dc.com
from-de.com from-fl.com from-ga.com from-hi.com from-ia.com from-id.com from-il.com from-in.com from-ks.com
from-ky.com from-la.net from-ma.com from-md.com from-me.org from-mi.com from-mn.com from-mo.com from-ms.com
from-mt.com from-nc.com from-nd.com from-ne.com from-nh.com from-nj.com from-nm.com from-nv.com from-ny.net
from-oh.com from-ok.com from-or.com from-pa.com from-pr.com from-ri.com from-sc.com from-sd.com from-tn.com
from-tx.com from-ut.com from-va.com from-vt.com from-wa.com from-wi.com from-wv.com from-wy.com from.hr frosinone.it
frosta.no froya.no fræna.no frøya.no fst.br ftpaccess.cc fuchu.hiroshima.jp fuchu.tokyo.jp fuchu.toyama.jp
fudai.iwate.jp fuefuki.yamanashi.jp fuel.aero fuettertdasnetz.de fuji.shizuoka.jp fujieda.shizuoka.jp
fujiidera.osaka.jp fujikawa.shizuoka.jp fujikawa.yamanashi.jp fujikawaguchiko.yamanashi.jp fujimi.nagano.jp
fujimi.saitama.jp fujimino.saitama.jp fujinomiya.shizuoka.jp fujioka.gunma.jp fujisato.akita.jp fujisawa.iwate.jp
fujisawa.kanagawa.jp fujishiro.ibaraki.jp fujiyoshida.yamanashi.jp fukagawa.hokkaido.jp fukaya.saitama.jp
fukuchi.fukuoka.jp fukuchiyama.kyoto.jp fukudomi.saga.jp fukui.fukui.jp fukui.jp fukumitsu.toyama.jp fukuoka.jp
fukuroi.shizuoka.jp fukusaki.hyogo.jp fukushima.fukushima.jp fukushima.hokkaido.jp fukushima.jp fukuyama.hiroshima.jp
funabashi.chiba.jp funagata.yamagata.jp funahashi.toyama.jp functions.fnc.fr-par.scw.cloud fundacio.museum fuoisku.no
fuossko.no furano.hokkaido.jp furniture.museum furubira.hokkaido.jp furudono.fukushima.jp furukawa.miyagi.jp fusa.no
fuso.aichi.jp fussa.tokyo.jp futaba.fukushima.jp futsu.nagasaki.jp futtsu.chiba.jp futurehosting.at futuremailing.at
fvg.it fylkesbibl.no fyresdal.no førde.no g.bg g.se g.vbrplsbx.io g12.br ga.us gaivuotna.no gallery.museum galsa.no
gamagori.aichi.jp game-host.org game-server.cc game.tw games.hu gamo.shiga.jp gamvik.no gangaviika.no gangwon.kr
garden.museum gateway.museum gaular.no gausdal.no gb.net gc.ca gd.cn gda.pl gdansk.pl gdynia.pl ge.it geek.nz
geekgalaxy.com geelvinck.museum gehirn.ne.jp geisei.kochi.jp gemological.museum gen.in gen.mi.us gen.ng gen.nz gen.tr
genkai.saga.jp genoa.it genova.it gentapps.com gentlentapis.com geo.br geology.museum geometre-expert.fr
georgia.museum georgia.su getmyip.com gets-it.net gg.ax ggf.br ghost.io giehtavuoatna.no giessen.museum gifu.gifu.jp
gifu.jp giize.com gildeskal.no gildeskål.no ginan.gifu.jp ginowan.okinawa.jp ginoza.okinawa.jp girlfriend.jp girly.jp
giske.no git-pages.rit.edu git-repos.de gitapp.si github.io githubpreview.dev githubusercontent.com gitlab.io
gitpage.si gjemnes.no gjerdrum.no gjerstad.no gjesdal.no gjovik.no gjøvik.no glas.museum glass.museum gleeze.com
gliding.aero glitch.me gliwice.pl global.prod.fastly.net global.ssl.fastly.net glogow.pl gloomy.jp gloppen.no
glug.org.uk gmina.pl gniezno.pl go.ci go.cr go.dyndns.org go.gov.br go.id go.it go.jp go.ke go.kr go.leg.br go.pw
go.th go.tj go.tz go.ug gob.ar gob.bo gob.cl gob.do gob.ec gob.es gob.gt gob.hn gob.mx gob.ni gob.pa gob.pe gob.pk
gob.sv gob.ve gobo.wakayama.jp godo.gifu.jp goiania.br goip.de gojome.akita.jp gok.pk gokase.miyazaki.jp gol.no
golffan.us gon.pk gonna.jp gonohe.aomori.jp googleapis.com googlecode.com gop.pk gorge.museum gorizia.it gorlice.pl
gos.pk gose.nara.jp gosen.niigata.jp goshiki.hyogo.jp gotdns.ch gotdns.com gotdns.org gotemba.shizuoka.jp
goto.nagasaki.jp gotpantheon.com gotsu.shimane.jp goupile.fr gouv.ci gouv.fr gouv.ht gouv.km gouv.ml gouv.sn gov.ac
gov.ae gov.af gov.al gov.ar gov.as gov.au gov.az gov.ba gov.bb gov.bf gov.bh gov.bm gov.bn gov.br gov.bs gov.bt gov.by
gov.bz gov.cd gov.cl gov.cm gov.cn gov.co gov.cu gov.cx gov.cy gov.dm gov.do gov.dz gov.ec gov.ee gov.eg gov.et gov.fj
gov.gd gov.ge gov.gh gov.gi gov.gn gov.gr gov.gu gov.gy gov.hk gov.ie gov.il gov.in gov.iq gov.ir gov.is gov.it gov.jo
gov.kg gov.ki gov.km gov.kn gov.kp gov.kw gov.kz gov.la gov.lb gov.lc gov.lk gov.lr gov.ls gov.lt gov.lv gov.ly gov.ma
gov.me gov.mg gov.mk gov.ml gov.mn gov.mo gov.mr gov.ms gov.mu gov.mv gov.mw gov.my gov.mz gov.nc.tr gov.ng gov.nl
gov.nr gov.om gov.ph gov.pk gov.pl gov.pn gov.pr gov.ps gov.pt gov.py gov.qa gov.rs gov.ru gov.rw gov.sa gov.sb gov.sc
gov.scot gov.sd gov.sg gov.sh gov.sl gov.so gov.ss gov.sx gov.sy gov.tj gov.tl gov.tm gov.tn gov.to gov.tr gov.tt
gov.tw gov.ua gov.uk gov.vc gov.ve gov.vn gov.ws gov.ye gov.za gov.zm gov.zw government.aero govt.nz gr.com gr.eu.org
gr.it gr.jp grajewo.pl gran.no grandrapids.museum grane.no granvin.no graphox.us gratangen.no graz.museum greater.jp
greta.fr grimstad.no griw.gov.pl groks-the.info groks-this.info grondar.za grong.no grosseto.it groundhandling.aero
group.aero grozny.ru grozny.su grp.lk gru.br grue.no gs.aa.no gs.ah.no gs.bu.no gs.cn gs.fm.no gs.hl.no gs.hm.no
gs.jan-mayen.no gs.mr.no gs.nl.no gs.nt.no gs.of.no gs.ol.no gs.oslo.no gs.rl.no gs.sf.no gs.st.no gs.svalbard.no
gs.tm.no gs.tr.no gs.va.no gs.vf.no gsj.bz gsm.pl gu.us guam.gu gub.uy guernsey.museum gujarat.in gujo.gifu.jp
gulen.no gunma.jp guovdageaidnu.no gushikami.okinawa.jp gv.ao gv.at gv.vc gwangju.kr gx.cn gyeongbuk.kr gyeonggi.kr
gyeongnam.kr gyokuto.kumamoto.jp gz.cn gáivuotna.no gálsá.no gáŋgaviika.no günstigbestellen.de günstigliefern.de h.bg
h.se ha.cn ha.no habikino.osaka.jp habmer.no haboro.hokkaido.jp hacca.jp hachijo.tokyo.jp hachinohe.aomori.jp
hachioji.tokyo.jp hachirogata.akita.jp hadano.kanagawa.jp hadsel.no haebaru.okinawa.jp haga.tochigi.jp hagebostad.no
hagi.yamaguchi.jp haibara.shizuoka.jp hakata.fukuoka.jp hakodate.hokkaido.jp hakone.kanagawa.jp hakuba.nagano.jp
hakui.ishikawa.jp hakusan.ishikawa.jp halden.no half.host halloffame.museum halsa.no ham-radio-op.net
hamada.shimane.jp hamamatsu.shizuoka.jp hamar.no hamaroy.no hamatama.saga.jp hamatonbetsu.hokkaido.jp hamburg.museum
hammarfeasta.no hammerfest.no hamura.tokyo.jp hanamaki.iwate.jp hanamigawa.chiba.jp hanawa.fukushima.jp handa.aichi.jp
handcrafted.jp handson.museum hanggliding.aero hannan.osaka.jp hanno.saitama.jp hanyu.saitama.jp hapmir.no
happou.akita.jp hara.nagano.jp haram.no hareid.no harima.hyogo.jp harstad.no harvestcelebration.museum hasama.oita.jp
hasami.nagasaki.jp hashbang.sh hashikami.aomori.jp hashima.gifu.jp hashimoto.wakayama.jp hasuda.saitama.jp
hasura-app.io hasura.app hasvik.no hatogaya.saitama.jp hatoyama.saitama.jp hatsukaichi.hiroshima.jp hattfjelldal.no
haugesund.no hawaii.museum hayakawa.yamanashi.jp hayashima.okayama.jp hazu.aichi.jp hb.cldmail.ru hb.cn he.cn
health-carereform.com health.museum health.nz health.vn heavy.jp heguri.nara.jp heimatunduhren.museum hekinan.aichi.jp
hellas.museum helsinki.museum hembygdsforbund.museum hemne.no hemnes.no hemsedal.no hepforge.org her.jp herad.no
here-for-more.info heritage.museum herokuapp.com herokussl.com heroy.more-og-romsdal.no heroy.nordland.no
herøy.møre-og-romsdal.no herøy.nordland.no heteml.net hi.cn hi.us hicam.net hichiso.gifu.jp hida.gifu.jp
hidaka.hokkaido.jp hidaka.kochi.jp hidaka.saitama.jp hidaka.wakayama.jp hidora.com higashi.fukuoka.jp
higashi.fukushima.jp higashi.okinawa.jp higashiagatsuma.gunma.jp higashichichibu.saitama.jp
higashihiroshima.hiroshima.jp higashiizu.shizuoka.jp higashiizumo.shimane.jp higashikagawa.kagawa.jp
higashikagura.hokkaido.jp higashikawa.hokkaido.jp higashikurume.tokyo.jp higashimatsushima.miyagi.jp
higashimatsuyama.saitama.jp higashimurayama.tokyo.jp higashinaruse.akita.jp higashine.yamagata.jp higashiomi.shiga.jp
higashiosaka.osaka.jp higashishirakawa.gifu.jp higashisumiyoshi.osaka.jp higashitsuno.kochi.jp higashiura.aichi.jp
higashiyama.kyoto.jp higashiyamato.tokyo.jp higashiyodogawa.osaka.jp higashiyoshino.nara.jp hiho.jp hiji.oita.jp
hikari.yamaguchi.jp hikawa.shimane.jp hikimi.shimane.jp hikone.shiga.jp himeji.hyogo.jp himeshima.oita.jp
himi.toyama.jp hino.tokyo.jp hino.tottori.jp hinode.tokyo.jp hinohara.tokyo.jp hioki.kagoshima.jp hippy.jp
hirado.nagasaki.jp hiraizumi.iwate.jp hirakata.osaka.jp hiranai.aomori.jp hirara.okinawa.jp hirata.fukushima.jp
hiratsuka.kanagawa.jp hiraya.nagano.jp hirogawa.wakayama.jp hirokawa.fukuoka.jp hirono.fukushima.jp hirono.iwate.jp
hiroo.hokkaido.jp hirosaki.aomori.jp hiroshima.jp hisayama.fukuoka.jp histoire.museum historical.museum
historicalsociety.museum historichouses.museum historisch.museum historisches.museum history.museum
historyofscience.museum hita.oita.jp hitachi.ibaraki.jp hitachinaka.ibaraki.jp hitachiomiya.ibaraki.jp
hitachiota.ibaraki.jp hitra.no hizen.saga.jp hjartdal.no hjelmeland.no hk.cn hk.com hk.org hl.cn hl.no hlx.live
hlx.page hlx3.page hm.no hn.cn hobby-site.com hobby-site.org hobol.no hobøl.no hof.no hofu.yamaguchi.jp hokkaido.jp
hokksund.no hokuryu.hokkaido.jp hokuto.hokkaido.jp hokuto.yamanashi.jp hol.no hole.no holmestrand.no holtalen.no
holtålen.no holy.jp home-webserver.de home.dyndns.org homebuilt.aero homedns.org homeftp.net homeftp.org homeip.net
homelink.one homelinux.com homelinux.net homelinux.org homeoffice.gov.uk homesecuritymac.com homesecuritypc.com
homesklep.pl homeunix.com homeunix.net homeunix.org honai.ehime.jp honbetsu.hokkaido.jp honefoss.no hongo.hiroshima.jp
honjo.akita.jp honjo.saitama.jp honjyo.akita.jp hoplix.shop hopto.me hopto.org hornindal.no horokanai.hokkaido.jp
horology.museum horonobe.hokkaido.jp horten.no hosp.uk hostedpi.com hosting-cluster.nl hostyhosting.io hotel.hu
hotel.lk hotel.tz hotelwithflight.com house.museum hoyanger.no hoylandet.no hr.eu.org hra.health hs.kr hs.run hs.zone
httpbin.org hu.com hu.eu.org hu.net huissier-justice.fr humanities.museum hungry.jp hurdal.no hurum.no hvaler.no
hyllestad.no hyogo.jp hyuga.miyazaki.jp hzc.io hábmer.no hámmárfeasta.no hápmir.no häkkinen.fi hå.no hægebostad.no
hønefoss.no høyanger.no høylandet.no i.bg i.ng i.ph i.se i234.me ia.us iamallama.com ibara.okayama.jp
ibaraki.ibaraki.jp ibaraki.jp ibaraki.osaka.jp ibestad.no ibigawa.gifu.jp ibxos.it ic.gov.pl ichiba.tokushima.jp
ichihara.chiba.jp ichikai.tochigi.jp ichikawa.chiba.jp ichikawa.hyogo.jp ichikawamisato.yamanashi.jp ichinohe.iwate.jp
ichinomiya.aichi.jp ichinomiya.chiba.jp ichinoseki.iwate.jp icurus.jp id.au id.firewalledreplit.co id.forgerock.io
id.ir id.lv id.ly id.repl.co id.us ide.kyoto.jp idf.il idrett.no idv.hk idv.tw ie.eu.org if.ua iglesias-carbonia.it
iglesiascarbonia.it iheya.okinawa.jp iida.nagano.jp iide.yamagata.jp iijima.nagano.jp iitate.fukushima.jp
iiyama.nagano.jp iizuka.fukuoka.jp iizuna.nagano.jp ikaruga.nara.jp ikata.ehime.jp ikawa.akita.jp ikeda.fukui.jp
ikeda.gifu.jp ikeda.hokkaido.jp ikeda.nagano.jp ikeda.osaka.jp iki.fi iki.nagasaki.jp ikoma.nara.jp ikusaka.nagano.jp
il.eu.org il.us ilawa.pl iliadboxos.it illustration.museum ilovecollege.info im.it imabari.ehime.jp
imageandsound.museum imakane.hokkaido.jp imari.saga.jp imb.br imizu.toyama.jp imperia.it impertrix.com
impertrixcdn.com in-addr.arpa in-berlin.de in-brb.de in-butter.de in-dsl.de in-dsl.net in-dsl.org in-the-band.net
in-vpn.de in-vpn.net in-vpn.org in.eu.org in.na in.net in.ni in.rs in.th in.ua in.us ina.ibaraki.jp ina.nagano.jp
ina.saitama.jp inabe.mie.jp inagawa.hyogo.jp inagi.tokyo.jp inami.toyama.jp inami.wakayama.jp inashiki.ibaraki.jp
inatsuki.fukuoka.jp inawashiro.fukushima.jp inazawa.aichi.jp inc.hk incheon.kr ind.br ind.gt ind.in ind.kw ind.tn
independent-commission.uk independent-inquest.uk independent-inquiry.uk independent-panel.uk independent-review.uk
inderoy.no inderøy.no indian.museum indiana.museum indianapolis.museum indianmarket.museum indie.porn indigena.bo
industria.bo ine.kyoto.jp inf.br inf.cu inf.mk inf.ua info.at info.au info.az info.bb info.bj info.bo info.co info.cx
info.ec info.et info.fj info.gu info.ht info.hu info.in info.ke info.ki info.la info.ls info.mv info.na info.nf
info.ni info.nr info.pk info.pl info.pr info.ro info.sd info.tn info.tr info.tt info.tz info.ve info.vn info.zm ing.pa
ingatlan.hu ino.kochi.jp instance.datadetect.com instances.spawn.cc instantcloud.cn insurance.aero int.ar int.az
int.bo int.ci int.co int.cv int.eu.org int.in int.is int.la int.lk int.mv int.mw int.ni int.pt int.ru int.tj int.tt
int.ve int.vn intelligence.museum interactive.museum internet-dns.de internet.in intl.tn inuyama.aichi.jp
inzai.chiba.jp io.in io.kg iobb.net iopsys.se ip.linodeusercontent.com ip6.arpa ipifony.net iraq.museum iris.arpa
iron.museum iruma.saitama.jp is-a-anarchist.com is-a-blogger.com is-a-bookkeeper.com is-a-bruinsfan.org
is-a-bulls-fan.com is-a-candidate.org is-a-caterer.com is-a-celticsfan.org is-a-chef.com is-a-chef.net is-a-chef.org
is-a-conservative.com is-a-cpa.com is-a-cubicle-slave.com is-a-democrat.com is-a-designer.com is-a-doctor.com
is-a-financialadvisor.com is-a-geek.com is-a-geek.net is-a-geek.org is-a-green.com is-a-guru.com is-a-hard-worker.com
is-a-hunter.com is-a-knight.org is-a-landscaper.com is-a-lawyer.com is-a-liberal.com is-a-libertarian.com
is-a-linux-user.org is-a-llama.com is-a-musician.com is-a-nascarfan.com is-a-nurse.com is-a-painter.com
is-a-patsfan.org is-a-personaltrainer.com is-a-photographer.com is-a-player.com is-a-republican.com is-a-rockstar.com
is-a-socialist.com is-a-soxfan.org is-a-student.com is-a-teacher.com is-a-techie.com is-a-therapist.com
is-an-accountant.com is-an-actor.com is-an-actress.com is-an-anarchist.com is-an-artist.com is-an-engineer.com
is-an-entertainer.com is-by.us is-certified.com is-found.org is-gone.com is-into-anime.com is-into-cars.com
is-into-cartoons.com is-into-games.com is-leet.com is-lost.org is-not-certified.com is-saved.org is-slick.com
is-uberleet.com is-very-bad.org is-very-evil.org is-very-good.org is-very-nice.org is-very-sweet.org
is-with-theband.com is.eu.org is.gov.pl is.it isa-geek.com isa-geek.net isa-geek.org isa-hockeynut.com
isa.kagoshima.jp isa.us isahaya.nagasaki.jp ise.mie.jp isehara.kanagawa.jp isen.kagoshima.jp isernia.it iserv.dev
iservschule.de isesaki.gunma.jp ishigaki.okinawa.jp ishikari.hokkaido.jp ishikawa.fukushima.jp ishikawa.jp
ishikawa.okinawa.jp ishinomaki.miyagi.jp isla.pr isleofman.museum isshiki.aichi.jp issmarterthanyou.com isteingeek.de
istmein.de isumi.chiba.jp it.ao it.com it.eu.org it1.eur.aruba.jenv-aruba.cloud it1.jenv-aruba.cloud itabashi.tokyo.jp
itako.ibaraki.jp itakura.gunma.jp itami.hyogo.jp itano.tokushima.jp itayanagi.aomori.jp itcouldbewor.se itigo.jp
ito.shizuoka.jp itoigawa.niigata.jp itoman.okinawa.jp its.me ivano-frankivsk.ua ivanovo.su iveland.no ivgu.no
iwade.wakayama.jp iwafune.tochigi.jp iwaizumi.iwate.jp iwaki.fukushima.jp iwakuni.yamaguchi.jp iwakura.aichi.jp
iwama.ibaraki.jp iwamizawa.hokkaido.jp iwanai.hokkaido.jp iwanuma.miyagi.jp iwata.shizuoka.jp iwate.iwate.jp iwate.jp
iwatsuki.saitama.jp iwi.nz iyo.ehime.jp iz.hr izena.okinawa.jp izu.shizuoka.jp izumi.kagoshima.jp izumi.osaka.jp
izumiotsu.osaka.jp izumisano.osaka.jp izumizaki.fukushima.jp izumo.shimane.jp izumozaki.niigata.jp
izunokuni.shizuoka.jp j.bg j.layershift.co.uk j.scaleforce.com.cy j.scaleforce.net jab.br jambyl.su jamison.museum
jampa.br jan-mayen.no jaworzno.pl jc.neen.it jcloud-ver-jpc.ik-server.com jcloud.ik-server.com jcloud.kz jdevcloud.com
jdf.br jed.wafaicloud.com jefferson.museum jeju.kr jelastic.dogado.eu jelastic.regruhosting.ru
jelastic.saveincloud.net jelastic.team jelastic.tsukaeru.net jele.cloud jele.club jele.host jele.io jele.site
jelenia-gora.pl jellybean.jp jeonbuk.kr jeonnam.kr jerusalem.museum jessheim.no jevnaker.no jewelry.museum
jewish.museum jewishart.museum jfk.museum jgora.pl jinsekikogen.hiroshima.jp jl.cn jls-sto1.elastx.net
jls-sto2.elastx.net jls-sto3.elastx.net joboji.iwate.jp jobs.tt joetsu.niigata.jp jogasz.hu johana.toyama.jp
joinville.br jolster.no jondal.no jor.br jorpeland.no joso.ibaraki.jp jotelulu.cloud journal.aero journalism.museum
journalist.aero joyo.kyoto.jp jozi.biz jp.eu.org jp.kg jp.md jp.net jpn.com js.cn js.org js.wpenginepowered.com ju.mp
judaica.museum judygarland.museum juedisches.museum juif.museum jur.pro jus.br jx.cn jølster.no jørpeland.no k.bg k.se
k12.ak.us k12.al.us k12.ar.us k12.as.us k12.az.us k12.ca.us k12.co.us k12.ct.us k12.dc.us k12.de.us k12.ec k12.fl.us
k12.ga.us k12.gu.us k12.ia.us k12.id.us k12.il k12.il.us k12.in.us k12.ks.us k12.ky.us k12.la.us k12.ma.us k12.md.us
k12.me.us k12.mi.us k12.mn.us k12.mo.us k12.ms.us k12.mt.us k12.nc.us k12.ne.us k12.nh.us k12.nj.us k12.nm.us
k12.nv.us k12.ny.us k12.oh.us k12.ok.us k12.or.us k12.pa.us k12.pr.us k12.sc.us k12.tn.us k12.tr k12.tx.us k12.ut.us
k12.va.us k12.vi k12.vi.us k12.vt.us k12.wa.us k12.wi.us k12.wy.us k8s.fr-par.scw.cloud k8s.nl-ams.scw.cloud
k8s.pl-waw.scw.cloud k8s.scw.cloud kaas.gg kadena.okinawa.jp kadogawa.miyazaki.jp kadoma.osaka.jp kafjord.no
kaga.ishikawa.jp kagami.kochi.jp kagamiishi.fukushima.jp kagamino.okayama.jp kagawa.jp kagoshima.jp
kagoshima.kagoshima.jp kaho.fukuoka.jp kahoku.ishikawa.jp kahoku.yamagata.jp kai.yamanashi.jp kainan.tokushima.jp
kainan.wakayama.jp kaisei.kanagawa.jp kaita.hiroshima.jp kaizuka.osaka.jp kakamigahara.gifu.jp kakegawa.shizuoka.jp
kakinoki.shimane.jp kakogawa.hyogo.jp kakuda.miyagi.jp kalisz.pl kalmykia.ru kalmykia.su kaluga.su kamagaya.chiba.jp
kamaishi.iwate.jp kamakura.kanagawa.jp kameoka.kyoto.jp kameyama.mie.jp kami.kochi.jp kami.miyagi.jp
kamiamakusa.kumamoto.jp kamifurano.hokkaido.jp kamigori.hyogo.jp kamiichi.toyama.jp kamiizumi.saitama.jp
kamijima.ehime.jp kamikawa.hokkaido.jp kamikawa.hyogo.jp kamikawa.saitama.jp kamikitayama.nara.jp kamikoani.akita.jp
kamimine.saga.jp kaminokawa.tochigi.jp kaminoyama.yamagata.jp kamioka.akita.jp kamisato.saitama.jp
kamishihoro.hokkaido.jp kamisu.ibaraki.jp kamisunagawa.hokkaido.jp kamitonda.wakayama.jp kamitsue.oita.jp
kamo.kyoto.jp kamo.niigata.jp kamoenai.hokkaido.jp kamogawa.chiba.jp kanagawa.jp kanan.osaka.jp kanazawa.ishikawa.jp
kanegasaki.iwate.jp kaneyama.fukushima.jp kaneyama.yamagata.jp kani.gifu.jp kanie.aichi.jp kanmaki.nara.jp
kanna.gunma.jp kannami.shizuoka.jp kanonji.kagawa.jp kanoya.kagoshima.jp kanra.gunma.jp kanuma.tochigi.jp
kanzaki.saga.jp kapsi.fi karacol.su karaganda.su karasjohka.no karasjok.no karasuyama.tochigi.jp karate.museum
karatsu.saga.jp karelia.su karikatur.museum kariwa.niigata.jp kariya.aichi.jp karlsoy.no karmoy.no karmøy.no
karpacz.pl kartuzy.pl karuizawa.nagano.jp karumai.iwate.jp kasahara.gifu.jp kasai.hyogo.jp kasama.ibaraki.jp
kasamatsu.gifu.jp kasaoka.okayama.jp kashiba.nara.jp kashihara.nara.jp kashima.ibaraki.jp kashima.saga.jp
kashiwa.chiba.jp kashiwara.osaka.jp kashiwazaki.niigata.jp kasserver.com kasuga.fukuoka.jp kasuga.hyogo.jp
kasugai.aichi.jp kasukabe.saitama.jp kasumigaura.ibaraki.jp kasuya.fukuoka.jp kaszuby.pl katagami.akita.jp
katano.osaka.jp katashina.gunma.jp katori.chiba.jp katowice.pl katsuragi.nara.jp katsuragi.wakayama.jp
katsushika.tokyo.jp katsuura.chiba.jp katsuyama.fukui.jp kautokeino.no kawaba.gunma.jp kawachinagano.osaka.jp
kawagoe.mie.jp kawagoe.saitama.jp kawaguchi.saitama.jp kawahara.tottori.jp kawai.iwate.jp kawai.nara.jp kawaiishop.jp
kawajima.saitama.jp kawakami.nagano.jp kawakami.nara.jp kawakita.ishikawa.jp kawamata.fukushima.jp
kawaminami.miyazaki.jp kawanabe.kagoshima.jp kawanehon.shizuoka.jp kawanishi.hyogo.jp kawanishi.nara.jp
kawanishi.yamagata.jp kawara.fukuoka.jp kawasaki.miyagi.jp kawatana.nagasaki.jp kawaue.gifu.jp kawazu.shizuoka.jp
kayabe.hokkaido.jp kazimierz-dolny.pl kazo.saitama.jp kazuno.akita.jp keisen.fukuoka.jp keliweb.cloud
kembuchi.hokkaido.jp kep.tr kepno.pl ketrzyn.pl keymachine.de kg.kr kh.ua khakassia.su kharkiv.ua kharkov.ua
kherson.ua khmelnitskiy.ua khmelnytskyi.ua khplay.nl kibichuo.okayama.jp kicks-ass.net kicks-ass.org kids.museum
kids.us kiev.ua kiho.mie.jp kihoku.ehime.jp kijo.miyazaki.jp kikirara.jp kikonai.hokkaido.jp kikuchi.kumamoto.jp
kikugawa.shizuoka.jp kilatiron.com kill.jp kilo.jp kimino.wakayama.jp kimitsu.chiba.jp kimobetsu.hokkaido.jp
kin.okinawa.jp kinghost.net kinko.kagoshima.jp kinokawa.wakayama.jp kira.aichi.jp kirkenes.no kirovograd.ua
kiryu.gunma.jp kisarazu.chiba.jp kishiwada.osaka.jp kiso.nagano.jp kisofukushima.nagano.jp kisosaki.mie.jp
kita.kyoto.jp kita.osaka.jp kita.tokyo.jp kitaaiki.nagano.jp kitaakita.akita.jp kitadaito.okinawa.jp kitagata.gifu.jp
kitagata.saga.jp kitagawa.kochi.jp kitagawa.miyazaki.jp kitahata.saga.jp kitahiroshima.hokkaido.jp kitakami.iwate.jp
kitakata.fukushima.jp kitakata.miyazaki.jp kitami.hokkaido.jp kitamoto.saitama.jp kitanakagusuku.okinawa.jp
kitashiobara.fukushima.jp kitaura.miyazaki.jp kitayama.wakayama.jp kiwa.mie.jp kiwi.nz kiyama.saga.jp
kiyokawa.kanagawa.jp kiyosato.hokkaido.jp kiyose.tokyo.jp kiyosu.aichi.jp kizu.kyoto.jp klabu.no klepp.no klodzko.pl
klæbu.no km.ua kmpsp.gov.pl knightpoint.systems knowsitall.info knx-server.net kobayashi.miyazaki.jp kobierzyce.pl
kochi.jp kochi.kochi.jp kodaira.tokyo.jp koebenhavn.museum koeln.museum kofu.yamanashi.jp koga.fukuoka.jp
koga.ibaraki.jp koganei.tokyo.jp koge.tottori.jp koka.shiga.jp kokonoe.oita.jp kokubunji.tokyo.jp kolobrzeg.pl
komae.tokyo.jp komagane.nagano.jp komaki.aichi.jp komatsu.ishikawa.jp komatsushima.tokushima.jp komforb.se
kommunalforbund.se kommune.no komono.mie.jp komoro.nagano.jp komvux.se konan.aichi.jp konan.shiga.jp kongsberg.no
kongsvinger.no konin.pl konskowola.pl konsulat.gov.pl konyvelo.hu koobin.events koori.fukushima.jp kopervik.no
koriyama.fukushima.jp koryo.nara.jp kosai.shizuoka.jp kosaka.akita.jp kosei.shiga.jp koshigaya.saitama.jp
koshimizu.hokkaido.jp koshu.yamanashi.jp kosuge.yamanashi.jp kota.aichi.jp koto.shiga.jp koto.tokyo.jp
kotohira.kagawa.jp kotoura.tottori.jp kouhoku.saga.jp kounosu.saitama.jp kouyama.kagoshima.jp kouzushima.tokyo.jp
koya.wakayama.jp koza.wakayama.jp kozagawa.wakayama.jp kozaki.chiba.jp kozow.com kppsp.gov.pl kr.com kr.eu.org kr.it
kr.ua kraanghke.no kragero.no kragerø.no krakow.pl krasnik.pl krasnodar.su krellian.net kristiansand.no
kristiansund.no krodsherad.no krokstadelva.no krym.ua kråanghke.no krødsherad.no ks.ua ks.us ktistory.com
kuchinotsu.nagasaki.jp kudamatsu.yamaguchi.jp kudoyama.wakayama.jp kui.hiroshima.jp kuji.iwate.jp kuju.oita.jp
kujukuri.chiba.jp kuki.saitama.jp kuleuven.cloud kumagaya.saitama.jp kumakogen.ehime.jp kumamoto.jp
kumamoto.kumamoto.jp kumano.hiroshima.jp kumano.mie.jp kumatori.osaka.jp kumejima.okinawa.jp kumenan.okayama.jp
kumiyama.kyoto.jp kunigami.okinawa.jp kunimi.fukushima.jp kunisaki.oita.jp kunitachi.tokyo.jp kunitomi.miyazaki.jp
kunneppu.hokkaido.jp kunohe.iwate.jp kunst.museum kunstsammlung.museum kunstunddesign.museum kurashiki.okayama.jp
kurate.fukuoka.jp kure.hiroshima.jp kurgan.su kuriyama.hokkaido.jp kurobe.toyama.jp kurogi.fukuoka.jp
kuroishi.aomori.jp kuroiso.tochigi.jp kuromatsunai.hokkaido.jp kuron.jp kurotaki.nara.jp kurume.fukuoka.jp
kusatsu.gunma.jp kusatsu.shiga.jp kushima.miyazaki.jp kushimoto.wakayama.jp kushiro.hokkaido.jp kustanai.ru
kustanai.su kusu.oita.jp kutchan.hokkaido.jp kutno.pl kuwana.mie.jp kuzumaki.iwate.jp kv.ua kvafjord.no kvalsund.no
kvam.no kvanangen.no kvinesdal.no kvinnherad.no kviteseid.no kvitsoy.no kvitsøy.no kvæfjord.no kvænangen.no kwp.gov.pl
kwpsp.gov.pl ky.us kyiv.ua kyonan.chiba.jp kyotamba.kyoto.jp kyotanabe.kyoto.jp kyotango.kyoto.jp kyoto.jp
kyowa.akita.jp kyowa.hokkaido.jp kyuragi.saga.jp kárášjohka.no kåfjord.no l-o-g-i-n.de l.bg l.se la-spezia.it la.us
laakesvuemie.no lab.ms labor.museum labour.museum lahppi.no lajolla.museum lakas.hu lanbib.se lancashire.museum
land-4-sale.us landes.museum langevag.no langevåg.no lans.museum lapy.pl laquila.it lardal.no larsson.museum larvik.no
laspezia.it latina.it lavagis.no lavangen.no law.pro law.za laz.it lazio.it lc.it lcube-server.de le.it leadpages.co
leangaviika.no leasing.aero leaŋgaviika.no lebesby.no lebork.pl lebtimnetz.de lecce.it lecco.it leczna.pl leg.br
legnica.pl leikanger.no leirfjord.no leirvik.no leitungsen.de leka.no leksvik.no lel.br lelux.site lenug.su lenvik.no
lerdal.no lesja.no levanger.no lewismiller.museum lezajsk.pl lg.jp lg.ua li.it lib.ak.us lib.al.us lib.ar.us lib.as.us
lib.az.us lib.ca.us lib.co.us lib.ct.us lib.dc.us lib.de.us lib.ee lib.fl.us lib.ga.us lib.gu.us lib.hi.us lib.ia.us
lib.id.us lib.il.us lib.in.us lib.ks.us lib.ky.us lib.la.us lib.ma.us lib.md.us lib.me.us lib.mi.us lib.mn.us
lib.mo.us lib.ms.us lib.mt.us lib.nc.us lib.nd.us lib.ne.us lib.nh.us lib.nj.us lib.nm.us lib.nv.us lib.ny.us
lib.oh.us lib.ok.us lib.or.us lib.pa.us lib.pr.us lib.ri.us lib.sc.us lib.sd.us lib.tn.us lib.tx.us lib.ut.us
lib.va.us lib.vi.us lib.vt.us lib.wa.us lib.wi.us lib.wy.us lier.no lierne.no lig.it liguria.it likes-pie.com
likescandy.com lillehammer.no lillesand.no lima-city.at lima-city.ch lima-city.de lima-city.rocks lima.zone
limanowa.pl lincoln.museum lindas.no lindesnes.no lindås.no linkyard-cloud.ch linkyard.cloud linz.museum littlestar.jp
living.museum livinghistory.museum livorno.it lk3.ru ln.cn lo.it loabat.no loabát.no localhistory.museum
localhost.daplie.me localzone.xyz lodi.it lodingen.no log.br loginline.app loginline.dev loginline.io
loginline.services loginline.site loginto.me logistics.aero logoip.com logoip.de lohmus.me loisirs.bj lolipop.io
lolipopmc.jp lolitapunk.jp lom.it lom.no lombardia.it lombardy.it lomo.jp lomza.pl lon-1.paas.massivegrid.net
lon-2.paas.massivegrid.net lon.wafaicloud.com london.cloudapps.digital london.museum londrina.br loppa.no lorenskog.no
losangeles.museum loseyourip.com loten.no louvre.museum lovepop.jp lovesick.jp lowicz.pl loyalist.museum lpages.co
lpusercontent.com lt.eu.org lt.it lt.ua ltd.co.im ltd.cy ltd.gi ltd.hk ltd.lk ltd.ng ltd.ua ltd.uk lu.eu.org lu.it
lubartow.pl lubin.pl lublin.pl lucania.it lucca.it lucerne.museum lug.org.uk lugansk.ua lugs.org.uk lukow.pl lund.no
lunner.no luroy.no lurøy.no luster.no lutsk.ua luxembourg.museum luzern.museum lv.eu.org lv.ua lviv.ua lyngdal.no
lyngen.no lynx.mythic-beasts.com láhppi.no läns.museum lærdal.no lødingen.no lørenskog.no løten.no m.bg m.se ma.gov.br
ma.leg.br ma.us macapa.br maceio.br macerata.it machida.tokyo.jp mad.museum madrid.museum maebashi.gunma.jp
magazine.aero magnet.page maibara.shiga.jp mail.pl main.jp maintenance.aero maizuru.kyoto.jp makinohara.shizuoka.jp
makurazaki.kagoshima.jp malatvuopmi.no malbork.pl mallorca.museum malopolska.pl malselv.no malvik.no
mamurogawa.yamagata.jp manaus.br manchester.museum mandal.no mangyshlak.su maniwa.okayama.jp manno.kagawa.jp
mansion.museum mansions.museum mantova.it manx.museum maori.nz map.fastly.net map.fastlylb.net mar.it marburg.museum
marche.it marine.ru maringa.br maritime.museum maritimo.museum marker.no marnardal.no marugame.kagawa.jp
marumori.miyagi.jp maryland.museum marylhurst.museum masaki.ehime.jp masfjorden.no mashike.hokkaido.jp
mashiki.kumamoto.jp mashiko.tochigi.jp masoy.no massa-carrara.it massacarrara.it masuda.shimane.jp mat.br matera.it
matsubara.osaka.jp matsubushi.saitama.jp matsuda.kanagawa.jp matsudo.chiba.jp matsue.shimane.jp matsukawa.nagano.jp
matsumae.hokkaido.jp matsumoto.kagoshima.jp matsumoto.nagano.jp matsuno.ehime.jp matsusaka.mie.jp
matsushige.tokushima.jp matsushima.miyagi.jp matsuura.nagasaki.jp matsuyama.ehime.jp matsuzaki.shizuoka.jp
matta-varjjat.no mayfirst.info mayfirst.org mazeplay.com mazowsze.pl mazury.pl mb.ca mb.it mc.ax mc.eu.org mc.it
mcdir.me mcdir.ru mcpe.me mcpre.ru md.ci md.us me.eu.org me.in me.it me.ke me.so me.ss me.tc me.tz me.uk me.us me.vu
med.br med.ec med.ee med.ht med.ly med.om med.pa med.pl med.pro med.sa med.sd medecin.fr medecin.km media.aero
media.hu media.museum media.pl mediatech.by mediatech.dev medical.museum medicina.bo medio-campidano.it
mediocampidano.it medizinhistorisches.museum meeres.museum meguro.tokyo.jp mein-iserv.de mein-vigor.de meinforum.net
meiwa.gunma.jp meiwa.mie.jp mel.cloudlets.com.au meland.no meldal.no melhus.no meloy.no meløy.no members.linode.com
memorial.museum memset.net meraker.no merseine.nu meråker.no mesaverde.museum messerli.app messina.it messwithdns.com
meteorapp.com mex.com mg.gov.br mg.leg.br mi.it mi.th mi.us miasa.nagano.jp miasta.pl mibu.tochigi.jp michigan.museum
microlight.aero midatlantic.museum midori.chiba.jp midori.gunma.jp midsund.no midtre-gauldal.no mie.jp mielec.pl
mielno.pl mifune.kumamoto.jp mihama.aichi.jp mihama.chiba.jp mihama.fukui.jp mihama.mie.jp mihama.wakayama.jp
mihara.hiroshima.jp mihara.kochi.jp miharu.fukushima.jp miho.ibaraki.jp mikasa.hokkaido.jp mikawa.yamagata.jp
miki.hyogo.jp mil.ac mil.ae mil.al mil.ar mil.az mil.ba mil.bo mil.br mil.by mil.cl mil.cn mil.co mil.cy mil.do mil.ec
mil.eg mil.fj mil.ge mil.gh mil.gt mil.hn mil.id mil.in mil.iq mil.jo mil.kg mil.km mil.kr mil.kz mil.lv mil.mg mil.mv
mil.my mil.mz mil.ng mil.ni mil.no mil.nz mil.pe mil.ph mil.pl mil.py mil.qa mil.ru mil.rw mil.sh mil.st mil.sy mil.tj
mil.tm mil.to mil.tr mil.tw mil.tz mil.uy mil.vc mil.ve mil.ye mil.za mil.zm mil.zw milan.it milano.it military.museum
mill.museum mima.tokushima.jp mimata.miyazaki.jp minakami.gunma.jp minamata.kumamoto.jp minami-alps.yamanashi.jp
minami.fukuoka.jp minami.kyoto.jp minami.tokushima.jp minamiaiki.nagano.jp minamiashigara.kanagawa.jp
minamiawaji.hyogo.jp minamiboso.chiba.jp minamidaito.okinawa.jp minamiechizen.fukui.jp minamifurano.hokkaido.jp
minamiise.mie.jp minamiizu.shizuoka.jp minamimaki.nagano.jp minamiminowa.nagano.jp minamioguni.kumamoto.jp
minamisanriku.miyagi.jp minamitane.kagoshima.jp minamiuonuma.niigata.jp minamiyamashiro.kyoto.jp minano.saitama.jp
minato.osaka.jp minato.tokyo.jp mincom.tn mine.nu miners.museum mining.museum miniserver.com minisite.ms
minnesota.museum mino.gifu.jp minobu.yamanashi.jp minoh.osaka.jp minokamo.gifu.jp minowa.nagano.jp mintere.site
mircloud.host mircloud.ru mircloud.us misaki.okayama.jp misaki.osaka.jp misasa.tottori.jp misato.akita.jp
misato.miyagi.jp misato.saitama.jp misato.shimane.jp misato.wakayama.jp misawa.aomori.jp misconfused.org
mishima.fukushima.jp mishima.shizuoka.jp missile.museum missoula.museum misugi.mie.jp mitaka.tokyo.jp mitake.gifu.jp
mitane.akita.jp mito.ibaraki.jp mitou.yamaguchi.jp mitoyo.kagawa.jp mitsue.nara.jp mitsuke.niigata.jp
miura.kanagawa.jp miyada.nagano.jp miyagi.jp miyake.nara.jp miyako.fukuoka.jp miyako.iwate.jp miyakonojo.miyazaki.jp
miyama.fukuoka.jp miyama.mie.jp miyashiro.saitama.jp miyawaka.fukuoka.jp miyazaki.jp miyazaki.miyazaki.jp
miyazu.kyoto.jp miyoshi.aichi.jp miyoshi.hiroshima.jp miyoshi.saitama.jp miyoshi.tokushima.jp miyota.nagano.jp
mizuho.tokyo.jp mizumaki.fukuoka.jp mizunami.gifu.jp mizusawa.iwate.jp mjondalen.no mjøndalen.no mk.eu.org mk.ua
mlbfan.org mmafan.biz mn.it mn.us mo-i-rana.no mo-siemens.io mo.cn mo.it mo.us moareke.no mobara.chiba.jp mobi.gp
mobi.ke mobi.na mobi.ng mobi.tt mobi.tz mochizuki.nagano.jp mock.pstmn.io mod.gi modalen.no modelling.aero modena.it
modern.museum mods.jp modum.no moka.tochigi.jp mol.it molde.no molise.it moma.museum mombetsu.hokkaido.jp mond.jp
money.bj money.museum mongolian.jp monmouth.museum monticello.museum montreal.museum monza-brianza.it
monza-e-della-brianza.it monza.it monzabrianza.it monzaebrianza.it monzaedellabrianza.it moo.jp moonscale.net
mordovia.ru mordovia.su morena.br moriguchi.osaka.jp morimachi.shizuoka.jp morioka.iwate.jp moriya.ibaraki.jp
moriyama.shiga.jp moriyoshi.akita.jp morotsuka.miyazaki.jp moroyama.saitama.jp moscow.museum moseushi.hokkaido.jp
mosjoen.no mosjøen.no moskenes.no moss.no mosvik.no motegi.tochigi.jp motobu.okinawa.jp motorcycle.museum
motosu.gifu.jp motoyama.kochi.jp movimiento.bo mozilla-iot.org moåreke.no mp.br mr.no mragowo.pl ms.gov.br ms.it ms.kr
ms.leg.br ms.us msk.ru msk.su mt.eu.org mt.gov.br mt.it mt.leg.br mt.us muenchen.museum muenster.museum
mugi.tokushima.jp muika.niigata.jp mukawa.hokkaido.jp muko.kyoto.jp mulhouse.museum munakata.fukuoka.jp muncie.museum
muni.il muosat.no muosát.no mup.gov.pl murakami.niigata.jp murata.miyagi.jp murayama.yamagata.jp murmansk.su
muroran.hokkaido.jp muroto.kochi.jp mus.br mus.mi.us musashimurayama.tokyo.jp musashino.tokyo.jp museet.museum
museum.mv museum.mw museum.no museum.om museum.tt museumcenter.museum museumvereniging.museum music.museum musica.ar
musica.bo musician.io mutsu.aomori.jp mutsuzawa.chiba.jp mutual.ar mw.gov.pl mx.na my-firewall.org my-gateway.de
my-router.de my-vigor.de my-wan.de my.eu.org my.id myactivedirectory.com myamaze.net myasustor.com mycd.eu mycloud.by
mydatto.com mydatto.net myddns.rocks mydissent.net mydobiss.com mydrobo.com myds.me myeffect.net myfast.host
myfast.space myfirewall.org myforum.community myfritz.net myftp.biz myftp.org myhome-server.de myiphost.com myjino.ru
mykolaiv.ua mymailer.com.tw mymediapc.net myoko.niigata.jp mypep.link mypets.ws myphotos.cc mypi.co mypsx.net
myqnapcloud.com mysecuritycamera.com mysecuritycamera.net mysecuritycamera.org myshopblocks.com myshopify.com
myspreadshop.at myspreadshop.be myspreadshop.ca myspreadshop.ch myspreadshop.co.uk myspreadshop.com
myspreadshop.com.au myspreadshop.de myspreadshop.dk myspreadshop.es myspreadshop.fi myspreadshop.fr myspreadshop.ie
myspreadshop.it myspreadshop.net myspreadshop.nl myspreadshop.no myspreadshop.pl myspreadshop.se mytabit.co.il
mytabit.com mytis.ru mytuleap.com myvnc.com mywire.org málatvuopmi.no mátta-várjjat.no målselv.no måsøy.no māori.nz
n.bg n.se n4t.co na.it na4u.ru naamesjevuemie.no nabari.mie.jp nachikatsuura.wakayama.jp nagahama.shiga.jp
nagai.yamagata.jp nagano.jp nagano.nagano.jp naganohara.gunma.jp nagaoka.niigata.jp nagaokakyo.kyoto.jp
nagara.chiba.jp nagareyama.chiba.jp nagasaki.jp nagasaki.nagasaki.jp nagasu.kumamoto.jp nagato.yamaguchi.jp
nagatoro.saitama.jp nagawa.nagano.jp nagi.okayama.jp nagiso.nagano.jp nago.okinawa.jp naha.okinawa.jp nahari.kochi.jp
naie.hokkaido.jp naka.hiroshima.jp naka.ibaraki.jp nakadomari.aomori.jp nakagawa.fukuoka.jp nakagawa.hokkaido.jp
nakagawa.nagano.jp nakagawa.tokushima.jp nakagusuku.okinawa.jp nakagyo.kyoto.jp nakai.kanagawa.jp nakama.fukuoka.jp
nakamichi.yamanashi.jp nakamura.kochi.jp nakaniikawa.toyama.jp nakano.nagano.jp nakano.tokyo.jp nakanojo.gunma.jp
nakanoto.ishikawa.jp nakasatsunai.hokkaido.jp nakatane.kagoshima.jp nakatombetsu.hokkaido.jp nakatsugawa.gifu.jp
nakayama.yamagata.jp nakijin.okinawa.jp naklo.pl nalchik.ru nalchik.su namaste.jp namdalseid.no name.az name.eg
name.et name.fj name.hr name.jo name.mk name.mv name.my name.na name.ng name.pm name.pr name.qa name.tj name.tr
name.tt name.vn namegata.ibaraki.jp namegawa.saitama.jp namerikawa.toyama.jp namie.fukushima.jp namikata.ehime.jp
namsos.no namsskogan.no nanae.hokkaido.jp nanao.ishikawa.jp nanbu.tottori.jp nanbu.yamanashi.jp nango.fukushima.jp
nanjo.okinawa.jp nankoku.kochi.jp nanmoku.gunma.jp nannestad.no nanporo.hokkaido.jp nantan.kyoto.jp nanto.toyama.jp
nanyo.yamagata.jp naoshima.kagawa.jp naples.it napoli.it nara.jp nara.nara.jp narashino.chiba.jp narita.chiba.jp
naroy.no narusawa.yamanashi.jp naruto.tokushima.jp narviika.no narvik.no nasu.tochigi.jp nasushiobara.tochigi.jp
nat.tn natal.br national.museum nationalfirearms.museum nationalheritage.museum nativeamerican.museum natori.miyagi.jp
natural.bo naturalhistory.museum naturalhistorymuseum.museum naturalsciences.museum naturbruksgymn.se nature.museum
naturhistorisches.museum natuurwetenschappen.museum naumburg.museum naustdal.no naval.museum navigation.aero navoi.su
navuotna.no nayoro.hokkaido.jp nb.ca nc.tr nc.us nd.us ne.jp ne.ke ne.kr ne.pw ne.tz ne.ug ne.us neat-url.com
nebraska.museum nedre-eiker.no neko.am nemuro.hokkaido.jp nerdpol.ovh nerima.tokyo.jp nes.akershus.no nes.buskerud.no
nesna.no nesodden.no nesoddtangen.no nesseby.no nesset.no net-freaks.com net.ac net.ae net.af net.ag net.ai net.al
net.am net.ar net.au net.az net.ba net.bb net.bh net.bj net.bm net.bn net.bo net.br net.bs net.bt net.bz net.ci net.cm
net.cn net.co net.cu net.cw net.cy net.dm net.do net.dz net.ec net.eg net.et net.eu.org net.fj net.fm net.ge net.gg
net.gl net.gn net.gp net.gr net.gt net.gu net.gy net.hk net.hn net.ht net.id net.il net.im net.in net.iq net.ir net.is
net.je net.jo net.kg net.ki net.kn net.kw net.ky net.kz net.la net.lb net.lc net.lk net.lr net.ls net.lv net.ly net.ma
net.me net.mk net.ml net.mo net.ms net.mt net.mu net.mv net.mw net.mx net.my net.mz net.nf net.ng net.ni net.nr net.nz
net.om net.pa net.pe net.ph net.pk net.pl net.pn net.pr net.ps net.pt net.py net.qa net.ru net.rw net.sa net.sb net.sc
net.sd net.sg net.sh net.sl net.so net.ss net.st net.sy net.th net.tj net.tm net.tn net.to net.tr net.tt net.tw net.ua
net.uk net.uy net.uz net.vc net.ve net.vi net.vn net.vu net.ws net.ye net.za net.zm netlify.app neues.museum
newhampshire.museum newjersey.museum newmexico.museum newport.museum news.hu newspaper.museum newyork.museum
neyagawa.osaka.jp nf.ca nflfan.org nfshost.com ng.eu.org ngo.lk ngo.ng ngo.ph ngo.za ngrok.io nh-serv.co.uk nh.us
nhlfan.net nhs.uk nic.in nic.tj nic.za nichinan.miyazaki.jp nichinan.tottori.jp nid.io niepce.museum nieruchomosci.pl
niigata.jp niigata.niigata.jp niihama.ehime.jp niikappu.hokkaido.jp niimi.okayama.jp niiza.saitama.jp nikaho.akita.jp
niki.hokkaido.jp nikita.jp nikko.tochigi.jp nikolaev.ua ninohe.iwate.jp ninomiya.kanagawa.jp nirasaki.yamanashi.jp
nis.za nishi.fukuoka.jp nishi.osaka.jp nishiaizu.fukushima.jp nishiarita.saga.jp nishiawakura.okayama.jp
nishiazai.shiga.jp nishigo.fukushima.jp nishihara.kumamoto.jp nishihara.okinawa.jp nishiizu.shizuoka.jp
nishikata.tochigi.jp nishikatsura.yamanashi.jp nishikawa.yamagata.jp nishimera.miyazaki.jp nishinomiya.hyogo.jp
nishinoomote.kagoshima.jp nishinoshima.shimane.jp nishio.aichi.jp nishiokoppe.hokkaido.jp nishitosa.kochi.jp
nishiwaki.hyogo.jp nissedal.no nisshin.aichi.jp niteroi.br nittedal.no niyodogawa.kochi.jp nj.us
njs.jelastic.vps-host.net nl-ams-1.baremetal.scw.cloud nl.ca nl.ci nl.eu.org nl.no nm.cn nm.us no-ip.biz no-ip.ca
no-ip.co.uk no-ip.info no-ip.net no-ip.org no.com no.eu.org no.it nobeoka.miyazaki.jp noboribetsu.hokkaido.jp
nobushi.jp noda.chiba.jp noda.iwate.jp nodes.k8s.fr-par.scw.cloud nodes.k8s.nl-ams.scw.cloud
nodes.k8s.pl-waw.scw.cloud nog.community nogata.fukuoka.jp nogi.tochigi.jp noheji.aomori.jp noho.st nohost.me noip.me
noip.us nom.ad nom.ag nom.co nom.es nom.fr nom.km nom.mg nom.nc nom.ni nom.pa nom.pe nom.pl nom.re nom.ro nom.tm
nom.ve nom.za nombre.bo nome.cv nome.pt nomi.ishikawa.jp nonoichi.ishikawa.jp noop.app noor.jp nord-aurdal.no
nord-fron.no nord-odal.no norddal.no nordeste-idc.saveincloud.net nordkapp.no nordre-land.no nordreisa.no
nore-og-uvdal.no norfolk.museum north-kazakhstan.su north.museum nose.osaka.jp nosegawa.nara.jp noshiro.akita.jp
not.br notaires.fr notaires.km noticeable.news noticias.bo noto.ishikawa.jp notodden.no notogawa.shiga.jp notteroy.no
nov.ru nov.su novara.it novecore.site now-dns.net now-dns.org now-dns.top now.sh nowaruda.pl nozawaonsen.nagano.jp
nrw.museum ns.ca nsn.us nsupdate.info nsw.au nsw.edu.au nt.au nt.ca nt.edu.au nt.no nt.ro ntdll.top ntr.br nu.ca nu.it
numata.gunma.jp numata.hokkaido.jp numazu.shizuoka.jp nuoro.it nv.us nx.cn ny-1.paas.massivegrid.net
ny-2.paas.massivegrid.net ny.us nyaa.am nyan.to nyc.mn nyc.museum nyny.museum nysa.pl nyuzen.toyama.jp nz.basketball
nz.eu.org návuotna.no nååmesjevuemie.no nærøy.no nøtterøy.no o.bg o.se oamishirasato.chiba.jp oarai.ibaraki.jp
obama.fukui.jp obama.nagasaki.jp obanazawa.yamagata.jp obihiro.hokkaido.jp obira.hokkaido.jp obninsk.su obu.aichi.jp
obuse.nagano.jp oceanographic.museum oceanographique.museum ocelot.mythic-beasts.com ochi.kochi.jp od.ua
odate.akita.jp odawara.kanagawa.jp odda.no odesa.ua odessa.ua odo.br oe.yamagata.jp of.by of.je of.no off.ai
office-on-the.net official.academy official.ec ofunato.iwate.jp og.ao og.it oga.akita.jp ogaki.gifu.jp
ogano.saitama.jp ogasawara.tokyo.jp ogata.akita.jp ogawa.ibaraki.jp ogawa.nagano.jp ogawa.saitama.jp ogawara.miyagi.jp
ogi.saga.jp ogimi.okinawa.jp ogliastra.it ogori.fukuoka.jp ogose.saitama.jp oguchi.aichi.jp oguni.kumamoto.jp
oguni.yamagata.jp oh.us oharu.aichi.jp ohda.shimane.jp ohi.fukui.jp ohira.miyagi.jp ohira.tochigi.jp
ohkura.yamagata.jp ohtawara.tochigi.jp oi.kanagawa.jp oirase.aomori.jp oirm.gov.pl oishida.yamagata.jp
oiso.kanagawa.jp oita.jp oita.oita.jp oizumi.gunma.jp oji.nara.jp ojiya.niigata.jp ok.us okagaki.fukuoka.jp
okawa.fukuoka.jp okawa.kochi.jp okaya.nagano.jp okayama.jp okayama.okayama.jp okazaki.aichi.jp okegawa.saitama.jp
oketo.hokkaido.jp oki.fukuoka.jp okinawa.jp okinawa.okinawa.jp okinoshima.shimane.jp okoppe.hokkaido.jp oksnes.no
okuizumo.shimane.jp okuma.fukushima.jp okutama.tokyo.jp ol.no olawa.pl olbia-tempio.it olbiatempio.it olecko.pl
olkusz.pl olsztyn.pl omachi.nagano.jp omachi.saga.jp omaezaki.shizuoka.jp omaha.museum omasvuotna.no ome.tokyo.jp
omg.lol omi.nagano.jp omi.niigata.jp omigawa.chiba.jp omihachiman.shiga.jp omitama.ibaraki.jp omiya.saitama.jp
omniwe.site omotego.fukushima.jp omura.nagasaki.jp omuta.fukuoka.jp on-aptible.com on-the-web.tv on-web.fr on.ca
onagawa.miyagi.jp onavstack.net oncilla.mythic-beasts.com ondigitalocean.app onfabrica.com onflashdrive.app ong.br
onga.fukuoka.jp onjuku.chiba.jp online.museum online.th onna.okinawa.jp ono.fukui.jp ono.fukushima.jp ono.hyogo.jp
onojo.fukuoka.jp onomichi.hiroshima.jp onporter.run onred.one onrender.com ontario.museum onthewifi.com
onza.mythic-beasts.com ooguy.com ookuwa.nagano.jp oops.jp ooshika.nagano.jp openair.museum opencraft.hosting
opensocial.site operaunite.com opoczno.pl opole.pl oppdal.no oppegard.no oppegård.no or.at or.bi or.ci or.cr or.id
or.it or.jp or.ke or.kr or.mu or.na or.pw or.th or.tz or.ug or.us ora.gunma.jp orangecloud.tn oregon.museum
oregontrail.museum org.ac org.ae org.af org.ag org.ai org.al org.am org.ar org.au org.az org.ba org.bb org.bh org.bi
org.bj org.bm org.bn org.bo org.br org.bs org.bt org.bw org.bz org.ci org.cn org.co org.cu org.cv org.cw org.cy org.dm
org.do org.dz org.ec org.ee org.eg org.es org.et org.fj org.fm org.ge org.gg org.gh org.gi org.gl org.gn org.gp org.gr
org.gt org.gu org.gy org.hk org.hn org.ht org.hu org.il org.im org.in org.iq org.ir org.is org.je org.jo org.kg org.ki
org.km org.kn org.kp org.kw org.ky org.kz org.la org.lb org.lc org.lk org.lr org.ls org.lv org.ly org.ma org.me org.mg
org.mk org.ml org.mn org.mo org.ms org.mt org.mu org.mv org.mw org.mx org.my org.mz org.na org.ng org.ni org.nr org.nz
org.om org.pa org.pe org.pf org.ph org.pk org.pl org.pn org.pr org.ps org.pt org.py org.qa org.ro org.rs org.ru org.rw
org.sa org.sb org.sc org.sd org.se org.sg org.sh org.sl org.sn org.so org.ss org.st org.sv org.sy org.sz org.tj org.tm
org.tn org.to org.tr org.tt org.tw org.ua org.ug org.uk org.uy org.uz org.vc org.ve org.vi org.vn org.vu org.ws org.ye
org.yt org.za org.zm org.zw oristano.it orkanger.no orkdal.no orland.no orsites.com orskog.no orsta.no orx.biz
os.hedmark.no os.hordaland.no osaka.jp osakasayama.osaka.jp osaki.miyagi.jp osakikamijima.hiroshima.jp osasco.br
osen.no oseto.nagasaki.jp oshima.tokyo.jp oshima.yamaguchi.jp oshino.yamanashi.jp oshu.iwate.jp oslo.no osoyro.no
osteroy.no osterøy.no ostre-toten.no ostroda.pl ostroleka.pl ostrowiec.pl ostrowwlkp.pl osøyro.no ot.it ota.gunma.jp
ota.tokyo.jp otago.museum otake.hiroshima.jp otaki.chiba.jp otaki.nagano.jp otaki.saitama.jp otama.fukushima.jp
otari.nagano.jp otaru.hokkaido.jp ote.bj other.nf oto.fukuoka.jp otobe.hokkaido.jp otofuke.hokkaido.jp
otoineppu.hokkaido.jp otoyo.kochi.jp otsu.shiga.jp otsuchi.iwate.jp otsuki.kochi.jp otsuki.yamanashi.jp ouchi.saga.jp
ouda.nara.jp oum.gov.pl oumu.hokkaido.jp outsystemscloud.com overhalla.no ovre-eiker.no owani.aomori.jp
owariasahi.aichi.jp own.pm ownip.net ownprovider.com ox.rs oxa.cloud oxford.museum oy.lc oya.to oyabe.toyama.jp
oyama.tochigi.jp oyamazaki.kyoto.jp oyer.no oygarden.no oyodo.nara.jp oystre-slidre.no oz.au ozora.hokkaido.jp
ozu.ehime.jp ozu.kumamoto.jp p.bg p.se pa.gov.br pa.gov.pl pa.it pa.leg.br pa.us paas.beebyte.io paas.datacenter.fi
paas.hosted-by-previder.com paas.massivegrid.com pacific.museum paderborn.museum padova.it padua.it pagefrontapp.com
pages.dev pages.it.hs-heilbronn.de pages.torproject.net pages.wiardweb.com pagespeedmobilizer.com pagexl.com
palace.museum paleo.museum palermo.it palmas.br palmsprings.museum panama.museum panel.gg pantheonsite.io
parachuting.aero paragliding.aero parallel.jp parasite.jp paris.eu.org paris.museum parliament.nz parma.it
paroch.k12.ma.us parti.se pasadena.museum passenger-association.aero patria.bo pavia.it pb.ao pb.gov.br pb.leg.br
pc.it pc.pl pcloud.host pd.it pdns.page pe.ca pe.gov.br pe.it pe.kr pe.leg.br pecori.jp peewee.jp penne.jp penza.su
pepper.jp per.la per.nf per.sg perma.jp perso.ht perso.sn perso.tn perspecta.cloud perugia.it pesaro-urbino.it
pesarourbino.it pescara.it pg.in pg.it pgafan.net pgfog.com pharmacien.fr pharmaciens.km pharmacy.museum
philadelphia.museum philadelphiaarea.museum philately.museum phoenix.museum photography.museum phx.enscaled.us
pi.gov.br pi.it pi.leg.br piacenza.it piedmont.it piemonte.it pigboat.jp pila.pl pilot.aero pilots.museum pimienta.org
pinb.gov.pl pinoko.jp pippu.hokkaido.jp pisa.it pistoia.it pisz.pl pittsburgh.museum piw.gov.pl pixolino.com pl.eu.org
pl.ua planetarium.museum plantation.museum plants.museum platform0.app platter-app.com platter-app.dev platterp.us
playstation-cloud.com plaza.museum plc.co.im plc.ly plc.uk plesk.page pleskns.com plo.ps plurinacional.bo pmn.it pn.it
po.gov.pl po.it poa.br podhale.pl podlasie.pl podzone.net podzone.org point2this.com pointto.us poivron.org
pokrovsk.su pol.dz pol.ht pol.tr police.uk politica.bo polkowice.pl poltava.ua pomorskie.pl pomorze.pl poniatowa.pl
ponpes.id pordenone.it porsanger.no porsangu.no porsgrunn.no porsáŋgu.no port.fr portal.museum portland.museum
portlligat.museum post.in postman-echo.com posts-and-telecommunications.museum potager.org potenza.it powiat.pl
poznan.pl pp.az pp.ru pp.se pp.ua ppg.br pr.gov.br pr.it pr.leg.br pr.us prato.it prd.fr prd.km prd.mg
prequalifyme.today preservation.museum presidio.museum press.aero press.cy press.ma press.museum press.se presse.ci
presse.km presse.ml pri.ee primetel.cloud principe.st priv.at priv.hu priv.instances.scw.cloud priv.me priv.no priv.pl
privatelink.snowflake.app privatizehealthinsurance.net pro.az pro.br pro.cy pro.ec pro.fj pro.ht pro.in pro.mv pro.na
pro.om pro.pr pro.tt pro.typeform.com pro.vn prochowice.pl production.aero prof.pr profesional.bo project.museum
protonet.io pruszkow.pl prvcy.page przeworsk.pl psc.br psi.br psp.gov.pl psse.gov.pl pstmn.io pt.eu.org pt.it pu.it
pub.instances.scw.cloud pub.sa publ.pt public-inquiry.uk public.museum publishproxy.com pubol.museum pubtls.org
pueblo.bo pug.it puglia.it pulawy.pl punyu.jp pup.gov.pl pupu.jp pussycat.jp pv.it pvh.br pvt.ge pvt.k12.ma.us pya.jp
pyatigorsk.ru pymnt.uk pythonanywhere.com pz.it q-a.eu.org q.bg qa2.com qbuser.com qc.ca qc.com qcx.io qh.cn qld.au
qld.edu.au qld.gov.au qoto.io qsl.br qualifioapp.com quebec.museum quicksytes.com r.bg r.cdn77.net r.se r2.dev ra.it
rackmaze.com rackmaze.net rade.no radio.am radio.br radio.fm radom.pl radoy.no radøy.no raffleentry.org.uk
rag-cloud-ch.hosteur.com rag-cloud.hosteur.com ragusa.it rahkkeravju.no raholt.no railroad.museum railway.museum
raindrop.jp raisa.no rakkestad.no ralingen.no rana.no randaberg.no rankoshi.hokkaido.jp ranzan.saitama.jp rar.ve
ras.ru rauma.no ravendb.cloud ravendb.community ravendb.me ravendb.run ravenna.it ravpage.co.il rawa-maz.pl rc.it
rdv.to re.it re.kr read-books.org readmyblog.org readthedocs.io readymade.jp realestate.pl realm.cz rebun.hokkaido.jp
rec.br rec.co rec.nf rec.ro rec.ve recht.pro recife.br recreation.aero red.sv redirectme.net reg.dk reggio-calabria.it
reggio-emilia.it reggiocalabria.it reggioemilia.it reklam.hu rel.ht rel.pl remotewd.com rendalen.no rennebu.no
rennesoy.no rennesøy.no rep.br rep.kp repbody.aero repl.co repl.run res.aero res.in research.aero research.museum
reservd.com reservd.dev.thingdust.io reservd.disrec.thingdust.io reservd.testing.thingdust.io reserve-online.com
reserve-online.net resindevice.io resistance.museum restaurant.bj resto.bj revista.bo rg.it rhcloud.com ri.it ri.us
ribeirao.br ric.jelastic.vps-host.net rieti.it rifu.miyagi.jp riik.ee rikubetsu.hokkaido.jp rikuzentakata.iwate.jp
rimini.it rindal.no ringebu.no ringerike.no ringsaker.no rio.br riobranco.br riodejaneiro.museum riopreto.br
rishiri.hokkaido.jp rishirifuji.hokkaido.jp risor.no rissa.no risør.no ritto.shiga.jp rivne.ua rj.gov.br rj.leg.br
rl.no rm.it rn.gov.br rn.it rn.leg.br ro.eu.org ro.gov.br ro.im ro.it ro.leg.br roan.no rochester.museum
rockart.museum rocky.page rodoy.no rokunohe.aomori.jp rollag.no roma.it roma.museum rome.it romsa.no romskog.no
roros.no rost.no rotorcraft.aero router.management rovigo.it rovno.ua royal-commission.uk royken.no royrvik.no
rr.gov.br rr.leg.br rs.ba rs.gov.br rs.leg.br rsc.cdn77.org ru.com ru.eu.org ru.net run.app ruovat.no russia.museum
rv.ua rybnik.pl ryd.wafaicloud.com rygge.no ryokami.saitama.jp ryugasaki.ibaraki.jp ryuoh.shiga.jp rzeszow.pl
rzgw.gov.pl ráhkkerávju.no ráisa.no råde.no råholt.no rælingen.no rødøy.no rømskog.no røros.no røst.no røyken.no
røyrvik.no s.bg s.se s3-ap-northeast-1.amazonaws.com s3-ap-northeast-2.amazonaws.com s3-ap-south-1.amazonaws.com
s3-ap-southeast-1.amazonaws.com s3-ap-southeast-2.amazonaws.com s3-ca-central-1.amazonaws.com
s3-eu-central-1.amazonaws.com s3-eu-west-1.amazonaws.com s3-eu-west-2.amazonaws.com s3-eu-west-3.amazonaws.com
s3-external-1.amazonaws.com s3-fips-us-gov-west-1.amazonaws.com s3-sa-east-1.amazonaws.com s3-us-east-2.amazonaws.com
s3-us-gov-west-1.amazonaws.com s3-us-west-1.amazonaws.com s3-us-west-2.amazonaws.com
s3-website-ap-northeast-1.amazonaws.com s3-website-ap-southeast-1.amazonaws.com
s3-website-ap-southeast-2.amazonaws.com s3-website-eu-west-1.amazonaws.com s3-website-sa-east-1.amazonaws.com
s3-website-us-east-1.amazonaws.com s3-website-us-west-1.amazonaws.com s3-website-us-west-2.amazonaws.com
s3-website.ap-northeast-2.amazonaws.com s3-website.ap-south-1.amazonaws.com s3-website.ca-central-1.amazonaws.com
s3-website.eu-central-1.amazonaws.com s3-website.eu-west-2.amazonaws.com s3-website.eu-west-3.amazonaws.com
s3-website.fr-par.scw.cloud s3-website.nl-ams.scw.cloud s3-website.pl-waw.scw.cloud s3-website.us-east-2.amazonaws.com
s3.amazonaws.com s3.ap-northeast-2.amazonaws.com s3.ap-south-1.amazonaws.com s3.ca-central-1.amazonaws.com
s3.cn-north-1.amazonaws.com.cn s3.dualstack.ap-northeast-1.amazonaws.com s3.dualstack.ap-northeast-2.amazonaws.com
s3.dualstack.ap-south-1.amazonaws.com s3.dualstack.ap-southeast-1.amazonaws.com
s3.dualstack.ap-southeast-2.amazonaws.com s3.dualstack.ca-central-1.amazonaws.com
s3.dualstack.eu-central-1.amazonaws.com s3.dualstack.eu-west-1.amazonaws.com s3.dualstack.eu-west-2.amazonaws.com
s3.dualstack.eu-west-3.amazonaws.com s3.dualstack.sa-east-1.amazonaws.com s3.dualstack.us-east-1.amazonaws.com
s3.dualstack.us-east-2.amazonaws.com s3.eu-central-1.amazonaws.com s3.eu-west-2.amazonaws.com
s3.eu-west-3.amazonaws.com s3.fr-par.scw.cloud s3.nl-ams.scw.cloud s3.pl-waw.scw.cloud s3.teckids.org
s3.us-east-2.amazonaws.com sa-east-1.elasticbeanstalk.com sa.au sa.com sa.cr sa.edu.au sa.gov.au sa.gov.pl sa.it
sabae.fukui.jp sadist.jp sado.niigata.jp safety.aero saga.jp saga.saga.jp sagae.yamagata.jp sagamihara.kanagawa.jp
saigawa.fukuoka.jp saijo.ehime.jp saikai.nagasaki.jp saiki.oita.jp saintlouis.museum saitama.jp saitama.saitama.jp
saito.miyazaki.jp saka.hiroshima.jp sakado.saitama.jp sakae.chiba.jp sakae.nagano.jp sakahogi.gifu.jp sakai.fukui.jp
sakai.ibaraki.jp sakai.osaka.jp sakaiminato.tottori.jp sakaki.nagano.jp sakata.yamagata.jp sakawa.kochi.jp
sakegawa.yamagata.jp saku.nagano.jp sakuho.nagano.jp sakura.chiba.jp sakura.tochigi.jp sakuragawa.ibaraki.jp
sakurai.nara.jp sakyo.kyoto.jp salangen.no salat.no salem.museum salerno.it saltdal.no salud.bo salvador.br
salvadordali.museum salzburg.museum samegawa.fukushima.jp samnanger.no sampa.br samukawa.kanagawa.jp
sanagochi.tokushima.jp sanda.hyogo.jp sandcats.io sande.more-og-romsdal.no sande.møre-og-romsdal.no sande.vestfold.no
sande.xn--mre-og-romsdal-qqb.no sandefjord.no sandiego.museum sandnes.no sandnessjoen.no sandnessjøen.no sandoy.no
sandøy.no sanfrancisco.museum sango.nara.jp sanjo.niigata.jp sannan.hyogo.jp sannohe.aomori.jp sano.tochigi.jp
sanok.pl santabarbara.museum santacruz.museum santafe.museum santamaria.br santoandre.br sanuki.kagawa.jp
saobernardo.br saogonca.br saotome.st sar.it sardegna.it sardinia.it saroma.hokkaido.jp sarpsborg.no
sarufutsu.hokkaido.jp sasaguri.fukuoka.jp sasayama.hyogo.jp sasebo.nagasaki.jp saskatchewan.museum sassari.it
satosho.okayama.jp satsumasendai.kagoshima.jp satte.saitama.jp satx.museum sauda.no sauherad.no savannahga.museum
saves-the-whales.com savona.it sayama.osaka.jp sayama.saitama.jp sayo.hyogo.jp sb.ua sc.cn sc.gov.br sc.ke sc.kr
sc.leg.br sc.ls sc.tz sc.ug sc.us scalebook.scw.cloud sch.ae sch.id sch.ir sch.jo sch.lk sch.ly sch.ng sch.qa sch.sa
sch.so sch.ss sch.tf sch.wf sch.zm schlesisches.museum schoenbrunn.museum schokokeks.net schokoladen.museum
school.museum school.na school.nz school.za schoolbus.jp schools.nsw.edu.au schulplattform.de schulserver.de
schweiz.museum sci.eg science-fiction.museum science.museum scienceandhistory.museum scienceandindustry.museum
sciencecenter.museum sciencecenters.museum sciencehistory.museum sciences.museum sciencesnaturelles.museum
scientist.aero scotland.museum scrapper-site.net scrapping.cc scrysec.com sd.cn sd.us sdn.gov.pl sdscloud.pl se.eu.org
se.gov.br se.leg.br se.net seaport.museum sebastopol.ua sec.ps secaas.hk secret.jp securitytactics.com seg.br
seidat.net seihi.nagasaki.jp seika.kyoto.jp seiro.niigata.jp seirou.niigata.jp seiyo.ehime.jp sejny.pl
sekd1.beebyteapp.io seki.gifu.jp sekigahara.gifu.jp sekikawa.niigata.jp sel.no selbu.no selfip.biz selfip.com
selfip.info selfip.net selfip.org selje.no seljord.no sellfy.store sells-for-less.com sells-for-u.com sells-it.net
sellsyourhome.org semboku.akita.jp semine.miyagi.jp senasa.ar sennan.osaka.jp senseering.net seoul.kr
sera.hiroshima.jp seranishi.hiroshima.jp servebbs.com servebbs.net servebbs.org servebeer.com serveblog.net
servecounterstrike.com serveexchange.com serveftp.com serveftp.net serveftp.org servegame.com servegame.org
servehalflife.com servehttp.com servehumour.com serveirc.com serveminecraft.net servemp3.com servep2p.com
servepics.com servequake.com servers.run servesarcasm.com service.gov.scot service.gov.uk service.one services.aero
setagaya.tokyo.jp seto.aichi.jp setouchi.okayama.jp settlement.museum settlers.museum settsu.osaka.jp sevastopol.ua
sex.hu sex.pl sf.no sg-1.paas.massivegrid.net sh.cn shacknet.nu shakotan.hokkaido.jp shari.hokkaido.jp shell.museum
sherbrooke.museum shibata.miyagi.jp shibata.niigata.jp shibecha.hokkaido.jp shibetsu.hokkaido.jp shibukawa.gunma.jp
shibuya.tokyo.jp shichikashuku.miyagi.jp shichinohe.aomori.jp shiftcrypto.dev shiftcrypto.io shiftedit.io shiga.jp
shiiba.miyazaki.jp shijonawate.osaka.jp shika.ishikawa.jp shikabe.hokkaido.jp shikama.miyagi.jp shikaoi.hokkaido.jp
shikatsu.aichi.jp shiki.saitama.jp shikokuchuo.ehime.jp shima.mie.jp shimabara.nagasaki.jp shimada.shizuoka.jp
shimamaki.hokkaido.jp shimamoto.osaka.jp shimane.jp shimane.shimane.jp shimizu.hokkaido.jp shimizu.shizuoka.jp
shimoda.shizuoka.jp shimodate.ibaraki.jp shimofusa.chiba.jp shimogo.fukushima.jp shimoichi.nara.jp shimoji.okinawa.jp
shimokawa.hokkaido.jp shimokitayama.nara.jp shimonita.gunma.jp shimonoseki.yamaguchi.jp shimosuwa.nagano.jp
shimotsuke.tochigi.jp shimotsuma.ibaraki.jp shinagawa.tokyo.jp shinanomachi.nagano.jp shingo.aomori.jp
shingu.fukuoka.jp shingu.hyogo.jp shingu.wakayama.jp shinichi.hiroshima.jp shinjo.nara.jp shinjo.okayama.jp
shinjo.yamagata.jp shinjuku.tokyo.jp shinkamigoto.nagasaki.jp shinonsen.hyogo.jp shinshinotsu.hokkaido.jp
shinshiro.aichi.jp shinto.gunma.jp shintoku.hokkaido.jp shintomi.miyazaki.jp shinyoshitomi.fukuoka.jp
shiogama.miyagi.jp shiojiri.nagano.jp shioya.tochigi.jp shirahama.wakayama.jp shirakawa.fukushima.jp shirakawa.gifu.jp
shirako.chiba.jp shiranuka.hokkaido.jp shiraoi.hokkaido.jp shiraoka.saitama.jp shirataka.yamagata.jp
shiriuchi.hokkaido.jp shiroi.chiba.jp shiroishi.miyagi.jp shiroishi.saga.jp shirosato.ibaraki.jp
shishikui.tokushima.jp shiso.hyogo.jp shisui.chiba.jp shitara.aichi.jp shiwa.iwate.jp shizukuishi.iwate.jp shizuoka.jp
shizuoka.shizuoka.jp shobara.hiroshima.jp shonai.fukuoka.jp shonai.yamagata.jp shoo.okayama.jp shop.brendly.rs shop.ht
shop.hu shop.pl shop.ro shop.th shoparena.pl shopitsite.com shopselect.net shopware.store show.aero showa.fukushima.jp
showa.gunma.jp showa.yamanashi.jp shunan.yamaguchi.jp shw.io si.eu.org si.it sibenik.museum sic.it sicilia.it
sicily.it siellak.no siena.it sigdal.no siiites.com siljan.no silk.museum simple-url.com simplesite.com
simplesite.com.br simplesite.gr simplesite.pl sinaapp.com siracusa.it sirdal.no site.tb-hosting.com site.transip.me
siteleaf.net sites.static.land sjc.br sk.ca sk.eu.org skanit.no skanland.no skaun.no skedsmo.no skedsmokorset.no
ski.museum ski.no skien.no skierva.no skiervá.no skiptvet.no skjak.no skjervoy.no skjervøy.no skjåk.no sklep.pl
sko.gov.pl skoczow.pl skodje.no skole.museum skydiving.aero skygearapp.com skánit.no skånland.no slask.pl slattum.no
sld.do sld.pa slg.br slupsk.pl slz.br sm.ua small-web.org smartlabeling.scw.cloud smola.no smushcdn.com smøla.no sn.cn
snaase.no snasa.no snillfjord.no snoasa.no snowflake.app snåase.no snåsa.no so.gov.pl so.it sobetsu.hokkaido.jp soc.dz
soc.lk soc.srcf.net sochi.su society.museum sodegaura.chiba.jp soeda.fukuoka.jp software.aero sogndal.no sogne.no
soja.okayama.jp soka.saitama.jp sokndal.no sola.no sologne.museum solund.no soma.fukushima.jp somna.no sondre-land.no
sondrio.it songdalen.no soni.nara.jp soo.kagoshima.jp sopot.pl sor-aurdal.no sor-fron.no sor-odal.no sor-varanger.no
sorfold.no sorocaba.br sorreisa.no sortland.no sorum.no sos.pl sosa.chiba.jp sosnowiec.pl soundandvision.museum
soundcast.me southcarolina.museum southwest.museum sowa.ibaraki.jp sp.gov.br sp.it sp.leg.br space-to-rent.com
space.museum spacekit.io spb.ru spb.su spdns.de spdns.eu spdns.org sphinx.mythic-beasts.com spjelkavik.no sport.hu
spy.museum spydeberg.no square.museum square7.ch square7.de square7.net sr.gov.pl sr.it srht.site srv.br ss.it
ssl.origin.cdn77-secure.org st.no staba.jp stackhero-network.com stadt.museum stage.nodeart.io staging.onred.one
stalbans.museum stalowa-wola.pl stange.no starachowice.pl stargard.pl starnberg.museum starostwo.gov.pl stat.no
state.museum stateofdelaware.museum stathelle.no static-access.net static.land static.observableusercontent.com
station.museum stavanger.no stavern.no steam.museum steiermark.museum steigen.no steinkjer.no sth.ac.at stjohn.museum
stjordal.no stjordalshalsen.no stjørdal.no stjørdalshalsen.no stockholm.museum stokke.no stor-elvdal.no
storage.yandexcloud.net stord.no stordal.no store.bb store.dk store.nf store.ro store.st store.ve storebase.store
storfjord.no storj.farm stpetersburg.museum strand.no stranda.no streamlit.app streamlitapp.com stripper.jp stryn.no
student.aero stuff-4-sale.org stuff-4-sale.us stufftoread.com stuttgart.museum su.paba.se sub.jp sue.fukuoka.jp
suedtirol.it suginami.tokyo.jp sugito.saitama.jp suifu.ibaraki.jp suisse.museum suita.osaka.jp sukagawa.fukushima.jp
sukumo.kochi.jp sula.no suldal.no suli.hu sumida.tokyo.jp sumita.iwate.jp sumoto.hyogo.jp sumoto.kumamoto.jp sumy.ua
sunagawa.hokkaido.jp sund.no sunndal.no sunnyday.jp supabase.co supabase.in supabase.net supersale.jp
surgeonshall.museum surnadal.no surrey.museum susaki.kochi.jp susono.shizuoka.jp suwa.nagano.jp suwalki.pl
suzaka.nagano.jp suzu.ishikawa.jp suzuka.mie.jp sv.it svalbard.no sveio.no svelvik.no svizzera.museum svn-repos.de
sweden.museum sweetpepper.org swidnica.pl swidnik.pl swiebodzin.pl swinoujscie.pl sx.cn sydney.museum sykkylven.no
syncloud.it syno-ds.de synology-diskstation.de synology-ds.de synology.me sytes.net szczecin.pl szczytno.pl szex.hu
szkola.pl sálat.no sálát.no søgne.no sømna.no søndre-land.no sør-aurdal.no sør-fron.no sør-odal.no sør-varanger.no
sørfold.no sørreisa.no sørum.no südtirol.it t.bg t.se t3l3p0rt.net ta.it taa.it tabayama.yamanashi.jp tabitorder.co.il
tabuse.yamaguchi.jp tachiarai.fukuoka.jp tachikawa.tokyo.jp tadaoka.osaka.jp tado.mie.jp tadotsu.kagawa.jp
tagajo.miyagi.jp tagami.niigata.jp tagawa.fukuoka.jp tahara.aichi.jp taifun-dns.de taiji.wakayama.jp taiki.hokkaido.jp
taiki.mie.jp tainai.niigata.jp taira.toyama.jp taishi.hyogo.jp taishi.osaka.jp taishin.fukushima.jp taito.tokyo.jp
taiwa.miyagi.jp tajimi.gifu.jp tajiri.osaka.jp taka.hyogo.jp takagi.nagano.jp takahagi.ibaraki.jp takahama.aichi.jp
takahama.fukui.jp takaharu.miyazaki.jp takahashi.okayama.jp takahata.yamagata.jp takaishi.osaka.jp takamatsu.kagawa.jp
takamori.kumamoto.jp takamori.nagano.jp takanabe.miyazaki.jp takanezawa.tochigi.jp takaoka.toyama.jp
takarazuka.hyogo.jp takasago.hyogo.jp takasaki.gunma.jp takashima.shiga.jp takasu.hokkaido.jp takata.fukuoka.jp
takatori.nara.jp takatsuki.osaka.jp takatsuki.shiga.jp takayama.gifu.jp takayama.gunma.jp takayama.nagano.jp
takazaki.miyazaki.jp takehara.hiroshima.jp taketa.oita.jp taketomi.okinawa.jp taki.mie.jp takikawa.hokkaido.jp
takino.hyogo.jp takinoue.hokkaido.jp takko.aomori.jp tako.chiba.jp taku.saga.jp tama.tokyo.jp tamakawa.fukushima.jp
tamaki.mie.jp tamamura.gunma.jp tamano.okayama.jp tamatsukuri.ibaraki.jp tamayu.shimane.jp tamba.hyogo.jp tana.no
tanabe.kyoto.jp tanabe.wakayama.jp tanagura.fukushima.jp tananger.no tank.museum tanohata.iwate.jp tara.saga.jp
tarama.okinawa.jp taranto.it targi.pl tarnobrzeg.pl tarui.gifu.jp tarumizu.kagoshima.jp tas.au tas.edu.au tas.gov.au
tashkent.su tatebayashi.gunma.jp tateshina.nagano.jp tateyama.chiba.jp tateyama.toyama.jp tatsuno.hyogo.jp
tatsuno.nagano.jp tawaramoto.nara.jp taxi.br tc.br tcm.museum tcp4.me te.it te.ua teaches-yoga.com tec.br tec.mi.us
tec.ve tech.orange technology.museum tecnologia.bo tel.tr tele.amune.org telebit.app telebit.io
telekommunikation.museum television.museum temp-dns.com tempio-olbia.it tempioolbia.it tempurl.host tendo.yamagata.jp
tenei.fukushima.jp tenkawa.nara.jp tenri.nara.jp teo.br teramo.it termez.su terni.it ternopil.ua teshikaga.hokkaido.jp
test-iserv.de test.ru test.tj texas.museum textile.museum tgory.pl the.br theater.museum theshop.jp theworkpc.com
thick.jp thingdustdata.com thruhere.net tickets.io time.museum time.no timekeeping.museum tingvoll.no tinn.no tj.cn
tjeldsund.no tjome.no tjøme.no tksat.bo tlon.network tm.cy tm.dz tm.fr tm.hu tm.km tm.mc tm.mg tm.no tm.pl tm.ro tm.se
tm.za tmp.br tn.it tn.oxa.cloud tn.us to.gov.br to.gt to.it to.leg.br to.md toba.mie.jp tobe.ehime.jp
tobetsu.hokkaido.jp tobishima.aichi.jp tochigi.jp tochigi.tochigi.jp tochio.niigata.jp toda.saitama.jp toei.aichi.jp
toga.toyama.jp togakushi.nagano.jp togane.chiba.jp togitsu.nagasaki.jp togliatti.su togo.aichi.jp togura.nagano.jp
tohma.hokkaido.jp tohnosho.chiba.jp toho.fukuoka.jp tokai.aichi.jp tokai.ibaraki.jp tokamachi.niigata.jp
tokashiki.okinawa.jp toki.gifu.jp tokigawa.saitama.jp tokke.no tokoname.aichi.jp tokorozawa.saitama.jp tokushima.jp
tokushima.tokushima.jp tokuyama.yamaguchi.jp tokyo.jp tolga.no tomakomai.hokkaido.jp tomari.hokkaido.jp tome.miyagi.jp
tomi.nagano.jp tomigusuku.okinawa.jp tomika.gifu.jp tomioka.gunma.jp tomisato.chiba.jp tomiya.miyagi.jp
tomobe.ibaraki.jp tonaki.okinawa.jp tonami.toyama.jp tondabayashi.osaka.jp tone.ibaraki.jp tonkotsu.jp tono.iwate.jp
tonosho.kagawa.jp tonsberg.no toolforge.org toon.ehime.jp topology.museum torahime.shiga.jp toride.ibaraki.jp
torino.it torino.museum torproject.net torsken.no tos.it tosa.kochi.jp tosashimizu.kochi.jp toscana.it
toshima.tokyo.jp tosu.saga.jp tottori.jp tottori.tottori.jp touch.museum tourism.bj tourism.pl tourism.tn
towada.aomori.jp town.museum townnews-staging.com toya.hokkaido.jp toyako.hokkaido.jp toyama.jp toyama.toyama.jp
toyo.kochi.jp toyoake.aichi.jp toyohashi.aichi.jp toyokawa.aichi.jp toyonaka.osaka.jp toyone.aichi.jp toyono.osaka.jp
toyooka.hyogo.jp toyosato.shiga.jp toyota.aichi.jp toyota.yamaguchi.jp toyotomi.hokkaido.jp toyotsu.fukuoka.jp
toyoura.hokkaido.jp tozawa.yamagata.jp tozsde.hu tp.it tr.eu.org tr.it tr.no tra.kp trader.aero trading.aero
traeumtgerade.de trafficplex.cloud trainer.aero trana.no tranby.no trani-andria-barletta.it trani-barletta-andria.it
traniandriabarletta.it tranibarlettaandria.it tranoy.no translate.goog translated.page transport.museum transporte.bo
tranøy.no trapani.it travel.in travel.pl travel.tt trd.br tree.museum trentin-sud-tirol.it trentin-sudtirol.it
trentin-sued-tirol.it trentin-suedtirol.it trentin-süd-tirol.it trentin-südtirol.it trentino-a-adige.it
trentino-aadige.it trentino-alto-adige.it trentino-altoadige.it trentino-s-tirol.it trentino-stirol.it
trentino-sud-tirol.it trentino-sudtirol.it trentino-sued-tirol.it trentino-suedtirol.it trentino-süd-tirol.it
trentino-südtirol.it trentino.it trentinoa-adige.it trentinoaadige.it trentinoalto-adige.it trentinoaltoadige.it
trentinos-tirol.it trentinostirol.it trentinosud-tirol.it trentinosudtirol.it trentinosued-tirol.it
trentinosuedtirol.it trentinosüd-tirol.it trentinosüdtirol.it trentinsud-tirol.it trentinsudtirol.it
trentinsued-tirol.it trentinsuedtirol.it trentinsüd-tirol.it trentinsüdtirol.it trento.it treviso.it trieste.it
troandin.no trogstad.no troitsk.su trolley.museum tromsa.no tromso.no tromsø.no trondheim.no trust.museum
trustee.museum try-snowplow.com trycloudflare.com trysil.no træna.no trøgstad.no ts.it ts.net tselinograd.su tsk.tr
tsu.mie.jp tsubame.niigata.jp tsubata.ishikawa.jp tsubetsu.hokkaido.jp tsuchiura.ibaraki.jp tsuga.tochigi.jp
tsugaru.aomori.jp tsuiki.fukuoka.jp tsukigata.hokkaido.jp tsukiyono.gunma.jp tsukuba.ibaraki.jp tsukui.kanagawa.jp
tsukumi.oita.jp tsumagoi.gunma.jp tsunan.niigata.jp tsuno.kochi.jp tsuno.miyazaki.jp tsuru.yamanashi.jp
tsuruga.fukui.jp tsurugashima.saitama.jp tsurugi.ishikawa.jp tsuruoka.yamagata.jp tsuruta.aomori.jp tsushima.aichi.jp
tsushima.nagasaki.jp tsuwano.shimane.jp tsuyama.okayama.jp tt.im tula.su tuleap-partners.com tunk.org tur.ar tur.br
turek.pl turin.it turystyka.pl tuscany.it tuva.su tuxfamily.org tv.bb tv.bo tv.br tv.im tv.in tv.it tv.kg tv.na tv.sd
tv.tr tv.tz tvedestrand.no tw.cn twmail.cc twmail.net twmail.org tx.us tychy.pl tydal.no tynset.no typedream.app
tysfjord.no tysnes.no tysvar.no tysvær.no tønsberg.no u.bg u.channelsdvr.net u.se u2-local.xnbay.com u2.xnbay.com
ua.rs ube.yamaguchi.jp uber.space uchihara.ibaraki.jp uchiko.ehime.jp uchinada.ishikawa.jp uchinomi.kagawa.jp ud.it
uda.nara.jp udi.br udine.it udono.mie.jp ueda.nagano.jp ueno.gunma.jp uenohara.yamanashi.jp ufcfan.org ug.gov.pl
ugim.gov.pl uhren.museum ui.nabu.casa uji.kyoto.jp ujiie.tochigi.jp ujitawara.kyoto.jp uk.com uk.eu.org uk.in uk.kg
uk.net uk.oxa.cloud uk.primetel.cloud uk.reclaim.cloud uk0.bigv.io uki.kumamoto.jp ukiha.fukuoka.jp ullensaker.no
ullensvang.no ulm.museum ulsan.kr ulvik.no um.gov.pl umaji.kochi.jp umb.it umbria.it umi.fukuoka.jp umig.gov.pl
unazuki.toyama.jp under.jp undersea.museum uni5.net unicloud.pl union.aero univ.bj univ.sn university.museum
unjarga.no unjárga.no unnan.shimane.jp unusualperson.com unzen.nagasaki.jp uonuma.niigata.jp uozu.toyama.jp up.in
upaas.kazteleport.kz upli.io upow.gov.pl upper.jp uppo.gov.pl urakawa.hokkaido.jp urasoe.okinawa.jp urausu.hokkaido.jp
urawa.saitama.jp urayasu.chiba.jp urbino-pesaro.it urbinopesaro.it ureshino.mie.jp uri.arpa url.tw urn.arpa
urown.cloud uruma.okinawa.jp uryu.hokkaido.jp us-1.evennode.com us-2.evennode.com us-3.evennode.com us-4.evennode.com
us-east-1.amazonaws.com us-east-1.elasticbeanstalk.com us-east-2.elasticbeanstalk.com
us-gov-west-1.elasticbeanstalk.com us-west-1.elasticbeanstalk.com us-west-2.elasticbeanstalk.com us.ax us.com
us.eu.org us.gov.pl us.in us.kg us.na us.org us.platform.sh us.reclaim.cloud usa.museum usa.oita.jp usantiques.museum
usarts.museum uscountryestate.museum usculture.museum usdecorativearts.museum user.aseinet.ne.jp user.party.eus
user.srcf.net usercontent.jp users.scale.virtualcloud.com.br usgarden.museum ushiku.ibaraki.jp ushistory.museum
ushuaia.museum uslivinghistory.museum usr.cloud.muni.cz ustka.pl usui.fukuoka.jp usuki.oita.jp ut.us utah.museum
utashinai.hokkaido.jp utazas.hu utazu.kagawa.jp uto.kumamoto.jp utsira.no utsunomiya.tochigi.jp utwente.io uvic.museum
uw.gov.pl uwajima.ehime.jp uwu.ai uy.com uz.ua uzhgorod.ua uzs.gov.pl v-info.info v.bg v.ua va.it va.no va.us
vaapste.no vadso.no vadsø.no vaga.no vagan.no vagsoy.no vaksdal.no val-d-aosta.it val-daosta.it vald-aosta.it
valdaosta.it valer.hedmark.no valer.ostfold.no valle-aosta.it valle-d-aosta.it valle-daosta.it valle.no valleaosta.it
valled-aosta.it valledaosta.it vallee-aoste.it vallee-d-aoste.it valleeaoste.it valleedaoste.it valley.museum
vallée-aoste.it vallée-d-aoste.it valléeaoste.it valléedaoste.it vang.no vantaa.museum vanylven.no vao.it vapor.cloud
vaporcloud.io vardo.no vardø.no varese.it varggat.no varoy.no vb.it vc.it vda.it ve.it vefsn.no vega.no vegarshei.no
vegårshei.no velvet.jp ven.it veneto.it venezia.it venice.it vennesla.no verbania.it vercel.app vercel.dev vercelli.it
verdal.no verona.it verran.no versailles.museum verse.jp versus.jp vestby.no vestnes.no vestre-slidre.no
vestre-toten.no vestvagoy.no vestvågøy.no vet.br veterinaire.fr veterinaire.km vevelstad.no vf.no
vfs.cloud9.af-south-1.amazonaws.com vfs.cloud9.ap-east-1.amazonaws.com vfs.cloud9.ap-northeast-1.amazonaws.com
vfs.cloud9.ap-northeast-2.amazonaws.com vfs.cloud9.ap-northeast-3.amazonaws.com vfs.cloud9.ap-south-1.amazonaws.com
vfs.cloud9.ap-southeast-1.amazonaws.com vfs.cloud9.ap-southeast-2.amazonaws.com vfs.cloud9.ca-central-1.amazonaws.com
vfs.cloud9.eu-central-1.amazonaws.com vfs.cloud9.eu-north-1.amazonaws.com vfs.cloud9.eu-south-1.amazonaws.com
vfs.cloud9.eu-west-1.amazonaws.com vfs.cloud9.eu-west-2.amazonaws.com vfs.cloud9.eu-west-3.amazonaws.com
vfs.cloud9.me-south-1.amazonaws.com vfs.cloud9.sa-east-1.amazonaws.com vfs.cloud9.us-east-1.amazonaws.com
vfs.cloud9.us-east-2.amazonaws.com vfs.cloud9.us-west-1.amazonaws.com vfs.cloud9.us-west-2.amazonaws.com vgs.no vi.it
vi.us vibo-valentia.it vibovalentia.it vic.au vic.edu.au vic.gov.au vicenza.it video.hu vik.no viking.museum vikna.no
village.museum vindafjord.no vinnica.ua vinnytsia.ua vip.jelastic.cloud vipsinaapp.com virginia.museum virtual-user.de
virtual.museum virtualserver.io virtualuser.de virtuel.museum viterbo.it vivian.jp vix.br vlaanderen.museum
vladikavkaz.ru vladikavkaz.su vladimir.ru vladimir.su vlog.br vm.bytemark.co.uk vn.ua voagat.no volda.no
volkenkunde.museum vologda.su volyn.ua voorloper.cloud voss.no vossevangen.no vp4.me vpndns.net vpnplus.to
vps-host.net vps.mcdir.ru vr.it vs.it vs.mythic-beasts.com vt.it vt.us vv.it vxl.sh várggát.no vågan.no vågsøy.no
vågå.no våler.hedmark.no våler.østfold.no værøy.no w.bg w.se wa.au wa.edu.au wa.gov.au wa.us wada.nagano.jp
wafflecell.com wajiki.tokushima.jp wajima.ishikawa.jp wakasa.fukui.jp wakasa.tottori.jp wakayama.jp
wakayama.wakayama.jp wake.okayama.jp wakkanai.hokkaido.jp wakuya.miyagi.jp walbrzych.pl wales.museum wallonie.museum
wanouchi.gifu.jp war.museum warabi.saitama.jp warmia.pl warszawa.pl washingtondc.museum washtenaw.mi.us
wassamu.hokkaido.jp watarai.mie.jp watari.miyagi.jp watch-and-clock.museum watchandclock.museum watson.jp waw.pl
wazuka.kyoto.jp we.bs we.tc web.app web.bo web.co web.do web.gu web.id web.in web.lk web.nf web.ni web.pk web.tj
web.tr web.ve web.za webhop.biz webhop.info webhop.me webhop.net webhop.org webhosting.be weblike.jp webredirect.org
website.yandexcloud.net webspace.rocks webthings.io webview-assets.cloud9.af-south-1.amazonaws.com
webview-assets.cloud9.ap-east-1.amazonaws.com webview-assets.cloud9.ap-northeast-1.amazonaws.com
webview-assets.cloud9.ap-northeast-2.amazonaws.com webview-assets.cloud9.ap-northeast-3.amazonaws.com
webview-assets.cloud9.ap-south-1.amazonaws.com webview-assets.cloud9.ap-southeast-1.amazonaws.com
webview-assets.cloud9.ap-southeast-2.amazonaws.com webview-assets.cloud9.ca-central-1.amazonaws.com
webview-assets.cloud9.eu-central-1.amazonaws.com webview-assets.cloud9.eu-north-1.amazonaws.com
webview-assets.cloud9.eu-south-1.amazonaws.com webview-assets.cloud9.eu-west-1.amazonaws.com
webview-assets.cloud9.eu-west-2.amazonaws.com webview-assets.cloud9.eu-west-3.amazonaws.com
webview-assets.cloud9.me-south-1.amazonaws.com webview-assets.cloud9.sa-east-1.amazonaws.com
webview-assets.cloud9.us-east-1.amazonaws.com webview-assets.cloud9.us-east-2.amazonaws.com
webview-assets.cloud9.us-west-1.amazonaws.com webview-assets.cloud9.us-west-2.amazonaws.com wedeploy.io wedeploy.me
wedeploy.sh weeklylottery.org.uk wegrow.pl wellbeingzone.co.uk wellbeingzone.eu west1-us.cloudjiffy.net western.museum
westeurope.azurestaticapps.net westfalen.museum westus2.azurestaticapps.net whaling.museum whitesnow.jp
whm.fr-par.scw.cloud whm.nl-ams.scw.cloud wi.us wielun.pl wien.funkfeuer.at wif.gov.pl wiih.gov.pl wiki.bo wiki.br
wildlife.museum williamsburg.museum winb.gov.pl windmill.museum wios.gov.pl witd.gov.pl withgoogle.com withyoutube.com
wiw.gov.pl wixsite.com wlocl.pl wloclawek.pl wmcloud.org wmflabs.org wnext.app wodzislaw.pl wolomin.pl
woltlab-demo.com workers.dev workinggroup.aero workisboring.com works.aero workshop.museum worse-than.tv
wpdevcloud.com wpenginepowered.com wphostedmail.com wpmucdn.com wpmudev.host writesthisblog.com wroc.pl wroclaw.pl
ws.na wsa.gov.pl wskr.gov.pl wuoz.gov.pl wv.us www.ro wy.us wzmiuw.gov.pl x.bg x.mythic-beasts.com x.se x443.pw
xen.prgmr.com xj.cn xn--0trq7p7nn.jp xn--12c1fe0br.xn--o3cw4h xn--12cfi8ixb8l.xn--o3cw4h xn--12co0c3b4eva.xn--o3cw4h
xn--1ctwo.jp xn--1lqs03n.jp xn--1lqs71d.jp xn--2m4a15e.jp xn--32vp30h.jp xn--41a.xn--p1acf xn--4dbgdty6c.xn--4dbrk0ce
xn--4it168d.jp xn--4it797k.jp xn--4pvxs.jp xn--55qx5d.cn xn--55qx5d.hk xn--55qx5d.xn--j6w193g xn--5dbhl8d.xn--4dbrk0ce
xn--5js045d.jp xn--5rtp49c.jp xn--5rtq34k.jp xn--6btw5a.jp xn--6orx2r.jp xn--7t0a264c.jp xn--80aaa0cvac.xn--p1acf
xn--80au.xn--90a3ac xn--8dbq2a.xn--4dbrk0ce xn--8ltr62k.jp xn--8pvr4u.jp xn--90a1af.xn--p1acf xn--90amc.xn--p1acf
xn--90azh.xn--90a3ac xn--9dbhblg6di.museum xn--andy-ira.no xn--aroport-bya.ci xn--asky-ira.no xn--aurskog-hland-jnb.no
xn--avery-yua.no xn--b-5ga.nordland.no xn--b-5ga.telemark.no xn--balsan-sdtirol-nsb.it xn--bdddj-mrabd.no
xn--bearalvhki-y4a.no xn--berlevg-jxa.no xn--bhcavuotna-s4a.no xn--bhccavuotna-k7a.no xn--bidr-5nac.no
xn--bievt-0qa.no xn--bjarky-fya.no xn--bjddar-pta.no xn--blt-elab.no xn--bmlo-gra.no xn--bod-2na.no
xn--bozen-sdtirol-2ob.it xn--brnny-wuac.no xn--brnnysund-m8ac.no xn--brum-voa.no xn--btsfjord-9za.no
xn--bulsan-sdtirol-nsb.it xn--c1avg.xn--90a3ac xn--c1avg.xn--p1acf xn--c3s14m.jp xn--cesena-forl-mcb.it
xn--cesenaforl-i8a.it xn--ciqpn.hk xn--comunicaes-v6a2o.museum xn--correios-e-telecomunicaes-ghc29a.museum
xn--czrw28b.tw xn--d1at.xn--90a3ac xn--d5qv7z876c.jp xn--davvenjrga-y4a.no xn--djrs72d6uy.jp xn--djty4k.jp
xn--dnna-gra.no xn--drbak-wua.no xn--dyry-ira.no xn--efvn9s.jp xn--ehqz56n.jp xn--elqq16h.jp xn--eveni-0qa01ga.no
xn--f6qx53a.jp xn--finny-yua.no xn--fjord-lra.no xn--fl-zia.no xn--flor-jra.no xn--forl-cesena-fcb.it
xn--forlcesena-c8a.it xn--frde-gra.no xn--frna-woa.no xn--frya-hra.no xn--ggaviika-8ya47h.no xn--gildeskl-g0a.no
xn--givuotna-8ya.no xn--gjvik-wua.no xn--gls-elac.no xn--gmq050i.hk xn--gmqw5a.hk xn--gmqw5a.xn--j6w193g
xn--gnstigbestellen-zvb.de xn--gnstigliefern-wob.de xn--h-2fa.no xn--h1aegh.museum xn--h1ahn.xn--p1acf
xn--h1aliz.xn--p1acf xn--h3cuzk1di.xn--o3cw4h xn--hbmer-xqa.no xn--hcesuolo-7ya35b.no xn--hebda8b.xn--4dbrk0ce
xn--hery-ira.nordland.no xn--hery-ira.xn--mre-og-romsdal-qqb.no xn--hgebostad-g3a.no xn--hkkinen-5wa.fi
xn--hmmrfeasta-s4ac.no xn--hnefoss-q1a.no xn--hobl-ira.no xn--holtlen-hxa.no xn--hpmir-xqa.no xn--hyanger-q1a.no
xn--hylandet-54a.no xn--indery-fya.no xn--io0a7i.cn xn--io0a7i.hk xn--j1adp.xn--p1acf xn--j1aef.xn--p1acf
xn--j1ael8b.xn--p1acf xn--jlster-bya.no xn--jrpeland-54a.no xn--k7yn95e.jp xn--karmy-yua.no xn--kbrq7o.jp
xn--kfjord-iua.no xn--klbu-woa.no xn--klt787d.jp xn--kltp7d.jp xn--kltx9a.jp xn--klty5x.jp xn--koluokta-7ya57h.no
xn--krager-gya.no xn--kranghke-b0a.no xn--krdsherad-m8a.no xn--krehamn-dxa.no xn--krjohka-hwab49j.no xn--ksnes-uua.no
xn--kvfjord-nxa.no xn--kvitsy-fya.no xn--kvnangen-k0a.no xn--l-1fa.no xn--laheadju-7ya.no xn--langevg-jxa.no
xn--lcvr32d.hk xn--ldingen-q1a.no xn--leagaviika-52b.no xn--lesund-hua.no xn--lgrd-poac.no xn--lhppi-xqa.no
xn--linds-pra.no xn--lns-qla.museum xn--loabt-0qa.no xn--lrdal-sra.no xn--lrenskog-54a.no xn--lt-liac.no
xn--lten-gra.no xn--lury-ira.no xn--m3ch0j3a.xn--o3cw4h xn--mely-ira.no xn--merker-kua.no xn--mgba3a4f16a.ir
xn--mgba3a4fra.ir xn--mjndalen-64a.no xn--mk0axi.hk xn--mkru45i.jp xn--mlatvuopmi-s4a.no xn--mli-tla.no
xn--mlselv-iua.no xn--moreke-jua.no xn--mori-qsa.nz xn--mosjen-eya.no xn--mot-tla.no xn--msy-ula0h.no
xn--mtta-vrjjat-k7af.no xn--muost-0qa.no xn--mxtq1m.hk xn--mxtq1m.xn--j6w193g xn--nit225k.jp xn--nmesjevuemie-tcba.no
xn--nry-yla5g.no xn--ntso0iqx3a.jp xn--ntsq17g.jp xn--nttery-byae.no xn--nvuotna-hwa.no xn--o1ac.xn--90a3ac
xn--o1ach.xn--90a3ac xn--o3cyx2a.xn--o3cw4h xn--od0alg.cn xn--od0alg.hk xn--od0alg.xn--j6w193g xn--od0aq3b.hk
xn--oppegrd-ixa.no xn--ostery-fya.no xn--osyro-wua.no xn--porsgu-sta26f.no xn--pssu33l.jp xn--qqqt11m.jp
xn--rady-ira.no xn--rdal-poa.no xn--rde-ula.no xn--rdy-0nab.no xn--rennesy-v1a.no xn--rhkkervju-01af.no
xn--rholt-mra.no xn--rht27z.jp xn--rht3d.jp xn--rht61e.jp xn--risa-5na.no xn--risr-ira.no xn--rland-uua.no
xn--rlingen-mxa.no xn--rmskog-bya.no xn--rny31h.jp xn--rros-gra.no xn--rskog-uua.no xn--rst-0na.no xn--rsta-fra.no
xn--ryken-vua.no xn--ryrvik-bya.no xn--s-1fa.no xn--sandnessjen-ogb.no xn--sandy-yua.no xn--sdtirol-n2a.it
xn--seral-lra.no xn--sgne-gra.no xn--skierv-uta.no xn--skjervy-v1a.no xn--skjk-soa.no xn--sknit-yqa.no
xn--sknland-fxa.no xn--slat-5na.no xn--slt-elab.no xn--smla-hra.no xn--smna-gra.no xn--snase-nra.no
xn--sndre-land-0cb.no xn--snes-poa.no xn--snsa-roa.no xn--sr-aurdal-l8a.no xn--sr-fron-q1a.no xn--sr-odal-q1a.no
xn--sr-varanger-ggb.no xn--srfold-bya.no xn--srreisa-q1a.no xn--srum-gra.no xn--stjrdal-s1a.no
xn--stjrdalshalsen-sqb.no xn--stre-toten-zcb.no xn--tjme-hra.no xn--tn0ag.hk xn--tnsberg-q1a.no xn--tor131o.jp
xn--trany-yua.no xn--trentin-sd-tirol-rzb.it xn--trentin-sdtirol-7vb.it xn--trentino-sd-tirol-c3b.it
xn--trentino-sdtirol-szb.it xn--trentinosd-tirol-rzb.it xn--trentinosdtirol-7vb.it xn--trentinsd-tirol-6vb.it
xn--trentinsdtirol-nsb.it xn--trgstad-r1a.no xn--trna-woa.no xn--troms-zua.no xn--tysvr-vra.no xn--uc0atv.hk
xn--uc0atv.tw xn--uc0atv.xn--j6w193g xn--uc0ay4a.hk xn--uist22h.jp xn--uisz3g.jp xn--unjrga-rta.no xn--uuwu58a.jp
xn--vads-jra.no xn--valle-aoste-ebb.it xn--valle-d-aoste-ehb.it xn--valleaoste-e7a.it xn--valledaoste-ebb.it
xn--vard-jra.no xn--vegrshei-c0a.no xn--vestvgy-ixa6o.no xn--vg-yiab.no xn--vgan-qoa.no xn--vgsy-qoa0j.no
xn--vgu402c.jp xn--vler-qoa.hedmark.no xn--vler-qoa.xn--stfold-9xa.no xn--vre-eiker-k8a.no xn--vrggt-xqad.no
xn--vry-yla5g.no xn--wcvs22d.hk xn--wcvs22d.xn--j6w193g xn--yer-zna.no xn--ygarden-p1a.no xn--ystre-slidre-ujb.no
xn--zbx025d.jp xn--zf0ao64a.tw xn--zf0avx.hk xnbay.com xs4all.space xx.gl xy.ax xz.cn y.bg y.se yabu.hyogo.jp
yabuki.fukushima.jp yachimata.chiba.jp yachiyo.chiba.jp yachiyo.ibaraki.jp yaese.okinawa.jp yahaba.iwate.jp
yahiko.niigata.jp yaita.tochigi.jp yaizu.shizuoka.jp yakage.okayama.jp yakumo.hokkaido.jp yakumo.shimane.jp
yali.mythic-beasts.com yalta.ua yamada.fukuoka.jp yamada.iwate.jp yamada.toyama.jp yamaga.kumamoto.jp yamagata.gifu.jp
yamagata.ibaraki.jp yamagata.jp yamagata.nagano.jp yamagata.yamagata.jp yamaguchi.jp yamakita.kanagawa.jp
yamamoto.miyagi.jp yamanakako.yamanashi.jp yamanashi.jp yamanashi.yamanashi.jp yamanobe.yamagata.jp
yamanouchi.nagano.jp yamashina.kyoto.jp yamato.fukushima.jp yamato.kanagawa.jp yamato.kumamoto.jp
yamatokoriyama.nara.jp yamatotakada.nara.jp yamatsuri.fukushima.jp yamazoe.nara.jp yame.fukuoka.jp yanagawa.fukuoka.jp
yanaizu.fukushima.jp yandexcloud.net yao.osaka.jp yaotsu.gifu.jp yasaka.nagano.jp yashio.saitama.jp yashiro.hyogo.jp
yasu.shiga.jp yasuda.kochi.jp yasugi.shimane.jp yasuoka.nagano.jp yatomi.aichi.jp yatsuka.shimane.jp
yatsushiro.kumamoto.jp yawara.ibaraki.jp yawata.kyoto.jp yawatahama.ehime.jp yazu.tottori.jp ybo.faith ybo.party
ybo.review ybo.science ybo.trade yk.ca yn.cn ynh.fr yoichi.hokkaido.jp yoita.niigata.jp yoka.hyogo.jp
yokaichiba.chiba.jp yokawa.hyogo.jp yokkaichi.mie.jp yokoshibahikari.chiba.jp yokosuka.kanagawa.jp yokote.akita.jp
yokoze.saitama.jp yolasite.com yombo.me yomitan.okinawa.jp yonabaru.okinawa.jp yonago.tottori.jp yonaguni.okinawa.jp
yonezawa.yamagata.jp yono.saitama.jp yorii.saitama.jp york.museum yorkshire.museum yoro.gifu.jp yosemite.museum
yoshida.saitama.jp yoshida.shizuoka.jp yoshikawa.saitama.jp yoshimi.saitama.jp yoshino.nara.jp yoshinogari.saga.jp
yoshioka.gunma.jp yotsukaido.chiba.jp youth.museum yuasa.wakayama.jp yufu.oita.jp yugawa.fukushima.jp
yugawara.kanagawa.jp yuki.ibaraki.jp yukuhashi.fukuoka.jp yura.wakayama.jp yurihonjo.akita.jp yusuhara.kochi.jp
yusui.kagoshima.jp yuu.yamaguchi.jp yuza.yamagata.jp yuzawa.niigata.jp z.bg z.se za.bz za.com za.net za.org
zachpomor.pl zagan.pl zakopane.pl zama.kanagawa.jp zamami.okinawa.jp zao.miyagi.jp zaporizhzhe.ua zaporizhzhia.ua
zapto.org zapto.xyz zarow.pl zentsuji.kagawa.jp zgora.pl zgorzelec.pl zhitomir.ua zhytomyr.ua zj.cn zlg.br zombie.jp
zoological.museum zoology.museum zp.gov.pl zp.ua zt.ua zushi.kanagawa.jp ákŋoluokta.no álaheadju.no áltá.no åfjord.no
åkrehamn.no ål.no ålesund.no ålgård.no åmli.no åmot.no årdal.no ås.no åseral.no åsnes.no øksnes.no ørland.no ørskog.no
ørsta.no østre-toten.no øvre-eiker.no øyer.no øygarden.no øystre-slidre.no čáhcesuolo.no ак.срб биз.рус иком.museum
ком.рус крым.рус мир.рус мск.рус обр.срб од.срб орг.рус орг.срб пр.срб самара.рус сочи.рус спб.рус упр.срб я.рус
אקדמיה.ישראל ירושלים.museum ישוב.ישראל ממשל.ישראל צהל.ישראל ايران.ir ایران.ir ทหาร.ไทย ธุรกิจ.ไทย รัฐบาล.ไทย ศึกษา.ไทย
องค์กร.ไทย เน็ต.ไทย 三重.jp 个人.hk 京都.jp 佐賀.jp 個人.hk 個人.香港 公司.cn 公司.hk 公司.香港 兵庫.jp 北海道.jp 千葉.jp 和歌山.jp 商業.tw 埼玉.jp 大分.jp
大阪.jp 奈良.jp 宮城.jp 宮崎.jp 富山.jp 山口.jp 山形.jp 山梨.jp 岐阜.jp 岡山.jp 岩手.jp 島根.jp 広島.jp 徳島.jp 愛媛.jp 愛知.jp 政府.hk 政府.香港 敎育.hk
教育.hk 教育.香港 新潟.jp 東京.jp 栃木.jp 沖縄.jp 滋賀.jp 熊本.jp 石川.jp 神奈川.jp 福井.jp 福岡.jp 福島.jp 秋田.jp 箇人.hk 組織.hk 組織.tw 組織.香港 組织.hk
網絡.cn 網絡.hk 網絡.香港 網络.hk 網路.tw 组織.hk 组织.hk 网絡.hk 网络.cn 网络.hk 群馬.jp 茨城.jp 長崎.jp 長野.jp 青森.jp 静岡.jp 香川.jp 高知.jp 鳥取.jp
鹿児島.jp
""".split()
EXACT = frozenset(r for r in RULES if r[0] not in "*!")
BELOW = frozenset(r[2:] for r in RULES if r[0] == "*")
EXCEPT = frozenset(r[1:] for r in RULES if r[0] == "!")
MOST_LABELS = max(r.count(".") + 1 for r in RULES)
