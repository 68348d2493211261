"""Labelled lines from which the trees of `pii` are learned.

Each is a line of text; personal data stands in «kind|value», and everything
else in it is none.  ``#`` stands for any digit, ``{w}`` for any of `NAMES`,
and ``L`` at the end of a card for the digit that makes its check sum right.
"""

from __future__ import annotations

NAMES = "anna bruno clara daniel emma felix greta hugo ines jonas karla luis maria nils olga pablo rosa simon tessa victor nova acme orbit globex delta lumen".split()

LINES = """
Write to «email|{w}.{w} (at) {w} dot com» for the details
my address is «email|{w} at {w} dot org»
contact «email|{w}[at]{w}.net» before noon
you can reach me under «email|{w}##@{w}(dot)com», thanks
E-Mail: «email|{w} @ {w}.de»
send it to «email|{w}-{w} [at] {w} [dot] co [dot] uk» please
«email|{w}{at}{w}.fr» is where the list lives
Kontakt: «email|{w}.{w} (at) {w} punkt de»
correo «email|{w}## at {w} dot es»
the owner is «email|{w}_{w}(at){w}.io» and nobody else
mail «email|{w}#(@){w}.com» or come by
write me: «email|{w} at {w} dot edu»
old mailbox «email|{w}.#### at {w} dot net» still works
«email|{w} (at) {w} (dot) org»
ask «email|{w}[@]{w}.eu» about it
«email|{w}.{w} at {w} dot com» answers
you find me: «email|{w}## at {w} dot net»
inbox «email|{w} (at) {w}.org» is full
the list «email|{w}-## at {w} dot io» is public
mail to «email|{w} [at] {w}.com» and wait
mein Postfach «email|{w} (at) {w} (punkt) de»
Look at {w}.com for more
we met at noon.{w} was late
have a look at {w}.org or elsewhere
she sold 4 @ 3.50 each
he stood at the dot on the map
arrive at home dot and wait
stay at {w} hotel.The room was fine
they looked at {w}.js and at {w}.py
prices start at 12.50 a piece
bought at {w}.de last year
12 at 4.5 percent
meet me at {w} point and bring {w}
the shop @ {w} street.Come early
stop at point dot point
games at {w}.net were cancelled
aim at the centre dot then fire
Tel. «phone|030 #######»
call «phone|(###) ###-####» now
phone: «phone|###-###-####»
Telefon: «phone|0##-#######»
fax «phone|00## ## #######»
mobile «phone|07### ######»
Tél. «phone|0# ## ## ## ##» le matin
you may ring «phone|020 #### ####» after six
teléfono «phone|9## ### ###»
my cell is «phone|###.###.####»
dial «phone|1-###-###-####» for help
WhatsApp «phone|0##########»
phone «phone|##########»
Handy: «phone|01## ########»
her number is «phone|(0##) ### ####», she said
text me at «phone|###-###-####» tonight
hotline «phone|0800 ### ####»
{w}, «phone|(###) ###-####», {w} street
rufen Sie «phone|0### / ######» an
portable «phone|06.##.##.##.##»
call «phone|8## ### ####» or write
Mobil «phone|0151-########»
{w} {w} «phone|0# ## ## ## ##»
contact {w} on «phone|01### ### ###»
the desk answers at «phone|(0##) ######» all day
Ihr Anruf: «phone|0#### ######»
fax: «phone|0##/#######»
{w} may be called under «phone|00## ### ### ###»
numéro «phone|0#.##.##.##.##»
please phone «phone|### ### ####» or come by
office «phone|(##) ####-####»
«phone|###-###-####» is what {w} wrote on the wall
«phone|(###) ###-####» rang twice
my number: «phone|0### ### ####»
order ###-#######-####### has shipped
steps ### ### #### in the log
blocks (##) ####-#### of the plan
codes (###) ###, (###) ### and more
lot 0### ######
model 0##-####### from the shelf
batch ###.###.####
case ###-###-#### of the court
sku ### ### ####
isbn 978-#-##-######-#
built on 2019-0#-1# by hand
on 1#.0#.20## it rained
numbers #### #### #### were drawn
between 1### and 1### people
the years 18## - 19##
a population of 1 ### ### in all
12 345 678 euros were paid
version 1.#.##.### is out
build 20######.# failed
invoice ########
id ##########
timestamp 16########
at 5#.##### 1#.##### north
sets of 21-1#, 19-2#, 21-#
serial ####-####-####
ssn ###-##-####
part no. ###-####
range 0.###-0.###
sum of 1.###.### and 2.###.###
parcel ## #### #### ####
article ###.###.## of the code
pages 12#-14#, 3##-4##
values ## ## ## ## ## in rows
Rechnung ###########
Bestellnummer ###-######
pedido ########
commande ### ### ###
the ratio 12:34:56 or ## / ## / ##
ticket 20##-#####
score 6-4 3-6 7-5 in ####
# ## ### #### are powers
room ###-### is free
account ########## at the bank
distance 384 ### km
ran ##.## ##.## ##.## seconds
ref ######-####
pay by card «card|####.####.####.###L»
card number «card|####/####/####/###L»
my amex «card|37## ###### ####L»
Kreditkarte «card|#### – #### – #### – ###L»
cc «card|####_####_####_###L» exp 12/2#
visa «card|####  ####  ####  ###L»
diners «card|36###########L»
amex «card|34############L»
credit card: «card|#### . #### . #### . ###L»
carte «card|####·####·####·###L» non
tarjeta «card|####.####.####.###L» caducada
american express «card|37##-######-####L»
debit «card|####--####--####--###L»
{w} paid with «card|####.####.####.###L»
mastercard «card|5###/####/####/###L» was charged
order ####.####.####.####
uuid ########-####-####-############
iban DE## #### #### #### #### ##
ratio 0.################
since 16###########
isbn 978##########
ean ############# on the box
tracking 1Z #### #### #### ####
account #### ###### #####
serial ####/####/####/####
sequence # # # # # # # # # # # # # # #
table 12 15 18 21 24 27 30 33
sample ##############
record ###############
log 20############
codes ####_####_####_####
gps 48.###### 11.######
license ####.####.####.####
points 1## 1## 1## 1## 1##
the attack came from «ip|1##[.]##[.]1##[.]##» overnight
beacon to «ip|2#[.]1##[.]#[.]1##», port 443
listen on «ip|2001:db8::#:#»
resolver «ip|2606:4700:####::####» is up
machine «ip|172 . 16 . # . ##» is slow
from «ip|2001:db8:####::#» yesterday
host «ip|fe80::#a##:#b#f»
blocked «ip|1##[.]1##[.]#.##» at the gateway
server «ip|10(.)#(.)#(.)##»
ping «ip|192 . 168 . # . ##» works
address «ip|2a0#:####:#:#a::##»
login from «ip|2001:0db8:85a#:0000:0000:8a2e:0370:7###»
IPv6 «ip|2a0#:#e#:#::#»
the node «ip|fd##:####:####::#» is down
DNS «ip|1##[.]##[.]2##[.]#» answered
route via «ip|1##{.}##{.}#{.}##»
client «ip|8#[dot]1##[dot]##[dot]#»
traffic from «ip|2604:####:####:#::a#» rose
C2 at «ip|4#[.]9#[.]1##[.]##»
adresse «ip|2a01:cb##:####:####:####:####:####:####»
proxy «ip|::ffff:c0a8:#a#»
started at 1#:##:##
mac aa:bb:cc:##:##:##
fingerprint aa:bb:#c:dd:e#:ff:##:##
std::a and std::b
the ratio 3:4:5
call ab::cd in c++
psalm 11#:#:#
it took 0#:##:##.## hours
class dead::beef is a joke
section 1 . 2 . 3 . 4
chapter 1.2 . 3.4 (5)
version [1.2] (.) 3 4 . 5
at 09:00:00 and 10:30:00
2:1:0 after penalties
build a::b::c
recipe 1 . 5 . 1 . 5 cups
duration ##:##:##:##
""".strip().split("\n")


def parsed(line: str) -> tuple[str, str, str, str | None]:
    """``(before, value, after, kind)`` of a line; without personal data all of it is ``before``."""
    before, mark, rest = line.partition("«")
    kind, _, rest = rest.partition("|")
    value, _, after = rest.partition("»")
    return before, value, after, kind if mark else None
