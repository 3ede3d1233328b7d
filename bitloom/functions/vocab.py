"""Fixed vocabularies and corrections of the network-flow feature job."""

# Categories in their fixed order. A value outside its list is an error.
PROTO = (
    "tcp udp arp ospf icmp igmp rtp ddp ipv6-frag cftp wsn pvp wb-expak mtp pri-enc sat-mon cphb sun-nd iso-ip xtp "
    "il unas mfe-nsp 3pc ipv6-route idrp bna swipe kryptolan cpnx rsvp wb-mon vmtp ib dgp eigrp ax.25 gmtp pnni sep "
    "pgm idpr-cmtp zero rvd mobile narp fc pipe ipcomp ipv6-no sat-expak ipv6-opts snp ipcv br-sat-mon ttp tcf "
    "nsfnet-igp sprite-rpc aes-sp3-d sccopmce sctp qnx scps etherip aris pim compaq-peer vrrp iatp stp l2tp srp sm "
    "isis smp fire ptp crtp sps merit-inp idpr skip any larp ipip micp encap ifmp tp++ a/n ipv6 i-nlsp ipx-n-ip sdrp "
    "tlsp gre mhrp ddx ippc visa secure-vmtp uti vines crudp iplt ggp ip ipnip st2 argus bbn-rcc egp emcon igp nvp "
    "pup xnet chaos mux dcn hmp prm trunk-1 xns-idp leaf-1 leaf-2 rdp irtp iso-tp4 netblt trunk-2 cbt"
).split()
SERVICE = "- ftp smtp snmp http ftp-data dns ssh radius pop3 dhcp ssl irc".split()
STATE = "FIN INT CON ECO REQ RST PAR URN no ACC CLO".split()

# Row position -> quantized value of column "rate".
RATE_OVERRIDES = {
    715: 34716, 11691: 25278, 27417: 5259117, 45319: 60744, 73620: 9039, 74498: 15070, 86933: 1024485,
    89021: 1689027, 90272: 5259117, 103372: 1562102, 118192: 1759777, 122489: 246327, 159266: 18853, 190473: 18423,
}

# Fixed value: number of leading rows that form the training part.
TRAIN_ROWS = 175341
