"""Grammars of the judged languages. Operators of one role share a terminal; precedence is left out, as only the
question whether a text parses is asked."""

JSON = """
file: value ;
value: STRING | NUMBER | 'true' | 'false' | 'null' | '{' '}' | '{' pair (',' pair)* '}' | '[' ']' | '[' value (',' value)* ']' ;
pair: STRING ':' value ;
"""

PYTHON = """
file: stmt* ;
field: yield_expr '='? | star_exprs '='? ;
name: NAME | 'match' | 'case' | 'type' ;
stmt: simple_line | compound ;
simple_line: simple (';' simple)* ';'? NEWLINE ;
block: NEWLINE INDENT stmt+ DEDENT | simple_line ;
simple: assignment | star_exprs | 'return' star_exprs? | import | 'raise' (expr ('from' expr)?)? | 'pass' | 'del' del_target (',' del_target)* ','? | yield_expr | 'assert' expr (',' expr)?
  | 'break' | 'continue' | 'global' name (',' name)* | 'nonlocal' name (',' name)* | 'type' name type_params? '=' expr ;
assignment: name ':' expr ('=' rhs)? | '(' single ')' ':' expr ('=' rhs)? | part ':' expr ('=' rhs)? | (star_targets '=')+ rhs | single AUG rhs ;
rhs: yield_expr | star_exprs ;
part: primary '.' name | primary '[' slices ']' ;
single: name | part | '(' single ')' ;
star_targets: star_target (',' star_target)* ','? ;
star_target: target | '*' target ;
target: name | part | '(' star_targets? ')' | '[' star_targets? ']' ;
del_target: name | part | '(' (del_target (',' del_target)* ','?)? ')' | '[' (del_target (',' del_target)* ','?)? ']' ;
import: 'import' dotted ('as' name)? (',' dotted ('as' name)?)* | 'from' dots? dotted 'import' imported | 'from' dots 'import' imported ;
dots: ('.' | '...')+ ;
dotted: name ('.' name)* ;
imported: '*' | '(' as_name (',' as_name)* ','? ')' | as_name (',' as_name)* ;
as_name: name ('as' name)? ;
compound: decorator* 'async'? 'def' name type_params? '(' params? ')' ('->' expr)? ':' block | decorator* 'class' name type_params? ('(' args? ')')? ':' block
  | 'if' named ':' block elif* else? | 'while' named ':' block else? | 'async'? 'for' star_targets 'in' star_exprs ':' block else? | 'async'? 'with' with_items ':' block
  | 'try' ':' block except+ else? finally? | 'try' ':' block except_star+ else? finally? | 'try' ':' block finally | 'match' subject ':' NEWLINE INDENT case+ DEDENT ;
decorator: '@' named NEWLINE ;
elif: 'elif' named ':' block ;
else: 'else' ':' block ;
finally: 'finally' ':' block ;
except: 'except' (expr ('as' name)?)? ':' block ;
except_star: 'except' '*' expr ('as' name)? ':' block ;
with_items: '(' with_item (',' with_item)* ','? ')' | with_item (',' with_item)* ;
with_item: expr ('as' star_target)? ;
subject: star_named ',' (star_named (',' star_named)* ','?)? | named ;
case: 'case' patterns ('if' named)? ':' block ;
patterns: pitem (',' pitem)* ','? ;
pitem: '*' name | pattern ;
pattern: closed ('|' closed)* ('as' name)? ;
closed: '-'? NUMBER (('+' | '-') NUMBER)? | strings | 'None' | 'True' | 'False' | dotted | '(' patterns? ')' | '[' patterns? ']' | '{' (mitem (',' mitem)* ','?)? '}'
  | dotted '(' (cpattern (',' cpattern)* ','?)? ')' ;
mitem: mkey ':' pattern | '**' name ;
mkey: '-'? NUMBER (('+' | '-') NUMBER)? | strings | 'None' | 'True' | 'False' | dotted ;
cpattern: pattern | name '=' pattern ;
type_params: '[' tparam (',' tparam)* ','? ']' ;
tparam: name (':' expr)? ('=' expr)? | '*' name ('=' star_expr)? | '**' name ('=' expr)? ;
params: positional ','? | positional ',' star_etc ','? | star_etc ','? ;
positional: nds | nds ',' ds | ds | nds ',' '/' | nds ',' '/' ',' nds | nds ',' '/' ',' nds ',' ds | nds ',' '/' ',' ds | nds ',' ds ',' '/' | nds ',' ds ',' '/' ',' ds | ds ',' '/' | ds ',' '/' ',' ds ;
nds: param | nds ',' param ;
ds: pdef | ds ',' pdef ;
param: name (':' expr)? ;
pdef: param '=' expr ;
kwp: param | pdef ;
star_etc: '*' name (':' star_expr)? (',' kwp)* (',' '**' param)? | '*' (',' kwp)+ (',' '**' param)? | '**' param ;
lparams: lpositional ','? | lpositional ',' lstar ','? | lstar ','? ;
lpositional: lnds | lnds ',' lds | lds | lnds ',' '/' | lnds ',' '/' ',' lnds | lnds ',' '/' ',' lnds ',' lds | lnds ',' '/' ',' lds | lnds ',' lds ',' '/' | lnds ',' lds ',' '/' ',' lds | lds ',' '/' | lds ',' '/' ',' lds ;
lnds: name | lnds ',' name ;
lds: ldef | lds ',' ldef ;
ldef: name '=' expr ;
lkw: name | ldef ;
lstar: '*' name (',' lkw)* (',' '**' name)? | '*' (',' lkw)+ (',' '**' name)? | '**' name ;
star_exprs: star_expr (',' star_expr)* ','? ;
star_expr: '*' bitor | expr ;
star_named: '*' bitor | named ;
named: name ':=' expr | expr ;
expr: disj | disj 'if' disj 'else' expr | 'lambda' lparams? ':' expr ;
disj: conj | disj 'or' conj ;
conj: inv | conj 'and' inv ;
inv: 'not' inv | comparison ;
comparison: bitor | comparison (CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not') bitor ;
bitor: unary | bitor (BOP | '+' | '-' | '*' | '/' | '**' | '@' | '|') unary ;
unary: ('+' | '-' | '~') unary | 'await'? primary ;
primary: atom | primary '.' name | primary '(' args? ')' | primary '(' named comp ')' | primary '[' slices ']' ;
args: parg (',' parg)* ','? | parg (',' parg)* ',' kws ','? | kws ','? ;
parg: '*' expr | named ;
kws: k1 (',' k1)* | k1 (',' k1)* (',' k2)+ | k2 (',' k2)* ;
k1: name '=' expr | '*' expr ;
k2: name '=' expr | '**' expr ;
slices: slice (',' slice)* ','? ;
slice: expr? ':' expr? (':' expr?)? | named | '*' bitor ;
atom: name | 'True' | 'False' | 'None' | NUMBER | strings | '...' | '(' ')' | '(' yield_expr ')' | '(' named ')' | '(' star_named ',' (star_named (',' star_named)* ','?)? ')' | '(' named comp ')'
  | '[' ']' | '[' star_named (',' star_named)* ','? ']' | '[' named comp ']' | '{' '}' | '{' dpair (',' dpair)* ','? '}' | '{' expr ':' expr comp '}' | '{' star_named (',' star_named)* ','? '}' | '{' named comp '}' ;
strings: STRING+ ;
dpair: expr ':' expr | '**' bitor ;
comp: ('async'? 'for' star_targets 'in' disj ('if' disj)*)+ ;
yield_expr: 'yield' 'from' expr | 'yield' star_exprs? ;
"""

JAVASCRIPT = """
file: stmt* ;
inner: expr ;
ident: NAME | 'async' | 'of' | 'get' | 'set' | 'static' | 'let' | 'await' | 'yield' ;
word: ident | KEYWORD | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import'
  | 'in' | 'instanceof' | 'new' | 'null' | 'return' | 'super' | 'switch' | 'this' | 'throw' | 'true' | 'false' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'with' ;
stmt: '{' stmt* '}' | 'var' vdecl (',' vdecl)* ';' | 'let' vdecl (',' vdecl)* ';' | 'const' cdecl (',' cdecl)* ';' | ';' | expr~stmt ';' | 'if' '(' expr ')' stmt ('else' stmt)?
  | 'do' stmt 'while' '(' expr ')' ';'? | 'while' '(' expr ')' stmt | 'for' '(' for_init? ';' expr? ';' expr? ')' stmt | 'for' 'await'? '(' for_of ')' stmt
  | 'continue' ident? ';' | 'break' ident? ';' | 'return' expr? ';' | 'with' '(' expr ')' stmt | 'switch' '(' expr ')' '{' clause* '}' | ident ':' stmt | 'throw' expr ';'
  | 'try' '{' stmt* '}' ('catch' ('(' binding ')')? '{' stmt* '}' ('finally' '{' stmt* '}')? | 'finally' '{' stmt* '}') | 'debugger' ';'
  | 'async'? 'function' '*'? ident '(' params? ')' '{' stmt* '}' | 'class' ident ('extends' lhs)? '{' member* '}' ;
for_init: 'var' vdecl (',' vdecl)* | 'let' vdecl (',' vdecl)* | 'const' cdecl (',' cdecl)* | expr ;
for_of: ('var' | 'let' | 'const')  binding ('in' | 'of') expr | lhs ('in' | 'of') expr | pattern ('in' | 'of') expr ;
clause: ('case' expr | 'default') ':' stmt* ;
vdecl: ident ('=' assign)? | pattern '=' assign ;
cdecl: binding '=' assign ;
binding: ident | pattern ;
pattern: '{' (bprop (',' bprop)* ','?)? '}' | '[' (belem? ',')* (belem | '...' binding)? ']' ;
bprop: ident ('=' assign)? | propname ':' belem | '...' ident ;
belem: binding ('=' assign)? | lhs ('=' assign)? ;
params: param (',' param)* ','? | (param ',')* '...' binding ;
param: binding ('=' assign)? ;
member: ';' | 'static'? method | 'static'? cname ('=' assign)? ';' | 'static' '{' stmt* '}' ;
method: ('async' | 'get' | 'set')? '*'? cname '(' params? ')' '{' stmt* '}' ;
cname: propname | PRIVATE ;
propname: word | STRING | NUMBER | '[' assign ']' ;
expr: assign (',' assign)* ;
assign: cond | lhs ('=' | ASG) assign | pattern '=' assign | 'async'? ident '=>' body | 'async'? '(' params? ')' '=>' body | 'yield' '*'? assign ;
body: '{' stmt* '}' | assign~brace ;
cond: bin | bin '?' assign ':' assign ;
bin: unary | bin (BOP | '+' | '-' | '*' | 'in' | 'instanceof') unary | PRIVATE 'in' unary ;
unary: ('delete' | 'void' | 'typeof' | '+' | '-' | '!' | 'await' | INC | NLINC) unary | lhs INC? ;
lhs: primary | 'new' lhs | 'new' '.' ident | lhs '.' (word | PRIVATE) | lhs '?.' (word | PRIVATE) | lhs '?.' '[' expr ']' | lhs '?.' '(' args? ')' | lhs '[' expr ']' | lhs '(' args? ')' | lhs TEMPLATE ;
args: arg (',' arg)* ','? ;
arg: assign | '...' assign ;
primary: 'this' | 'super' | 'import' '(' assign ')' | 'import' '.' ident | ident | NUMBER | STRING | REGEX | TEMPLATE | 'null' | 'true' | 'false' | '(' expr ')' | '[' (arg? ',')* arg? ']'
  | '{' (prop (',' prop)* ','?)? '}' | 'async'? 'function' '*'? ident? '(' params? ')' '{' stmt* '}' | 'class' ident? ('extends' lhs)? '{' member* '}' ;
prop: ident | propname ':' assign | method | '...' assign ;
"""

JAVA = """
file: package? import* typedecl* ;
name: NAME | 'record' | 'sealed' | 'permits' | 'yield' | 'when' ;
qname: name ('.' name)* ;
package: annotation* 'package' qname ';' ;
import: 'import' 'static'? qname ('.' '*')? ';' | ';' ;
typedecl: modifier* type_decl | ';' ;
modifier: annotation | MOD | 'static' | 'synchronized' | 'default' | 'sealed' | NONSEALED ;
annotation: '@' qname ('(' (annval | apair (',' apair)*)? ')')? ;
apair: name '=' annval ;
annval: cond | annotation | '{' (annval (',' annval)*)? ','? '}' ;
type_decl: 'class' name tparams? ('extends' type)? ('implements' types)? ('permits' types)? cbody | 'interface' name tparams? ('extends' types)? ('permits' types)? cbody
  | 'enum' name ('implements' types)? '{' (econst (',' econst)*)? ','? (';' member*)? '}' | 'record' name tparams? '(' fparams? ')' ('implements' types)? cbody | '@' 'interface' name cbody ;
econst: annotation* name ('(' args? ')')? cbody? ;
cbody: '{' member* '}' ;
member: ';' | 'static'? block | modifier* (type vdecl (',' vdecl)* ';' | tparams? (type | 'void') name '(' fparams? ')' dims? throws? (block | ';' | 'default' annval ';') | tparams? name '(' fparams? ')' throws? block | name block | type_decl) ;
throws: 'throws' types ;
types: type (',' type)* ;
vdecl: name dims? ('=' vinit)? ;
vinit: expr | array ;
array: '{' (vinit (',' vinit)*)? ','? '}' ;
fparams: fparam (',' fparam)* ;
fparam: modifier* type (annotation* '...')? name dims? | annotation* type (name '.')* 'this' ;
dims: (annotation* '[' ']')+ ;
type: annotation* base dims? ;
base: PRIM | ctype ;
ctype: name targs? ('.' annotation* name targs?)* ;
targs: '<' (targ (',' targ)*)? '>' ;
targ: type | annotation* '?' (('extends' | 'super') type)? ;
tparams: '<' tparam (',' tparam)* '>' ;
tparam: annotation* name ('extends' type ('&' type)*)? ;
block: '{' bstmt* '}' ;
bstmt: local ';' | modifier* type_decl | stmt ;
local: modifier* type vdecl (',' vdecl)* ;
stmt: block | ';' | action ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'assert' expr (':' expr)? ';' | switch | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (local | action (',' action)*)? ';' expr? ';' (action (',' action)*)? ')' stmt | 'for' '(' modifier* type name dims? ':' expr ')' stmt | 'break' name? ';' | 'continue' name? ';'
  | 'return' expr? ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | 'try' block catch* finally | 'try' block catch+ | 'try' '(' resource (';' resource)* ';'? ')' block catch* finally?
  | name ':' stmt | 'yield' expr ';' ;
catch: 'catch' '(' modifier* type ('|' type)* name ')' block ;
finally: 'finally' block ;
resource: local | primary ;
action: primary ('=' | ASG) expr | INC unary | primary INC | call | new ;
switch: 'switch' '(' expr ')' '{' group* '}' ;
group: label ':' bstmt* | label '->' (expr ';' | block | 'throw' expr ';') ;
label: 'case' choice (',' choice)* ('when' expr)? | 'default' ;
choice: cond | pattern | 'default' ;
pattern: modifier* type name | ctype '(' (pattern (',' pattern)*)? ')' name? ;
expr: cond | primary ('=' | ASG) expr | lambda ;
lambda: (name | '(' (fparams | name (',' name)*)? ')') '->' (expr | block) ;
cond: bin | bin '?' expr ':' (cond | lambda) ;
bin: unary | bin (BOP | '+' | '-' | '*' | '&' | '|' | '<' | '>' | '<' '<' | '>' '>' | '>' '>' '>') unary | bin 'instanceof' (type | pattern) ;
unary: ('+' | '-' | '!' | INC) unary | '(' type ('&' type)* ')' (unary | lambda) | primary INC? | switch ;
primary: literal | 'this' | name | '(' expr ')' | new | call | primary '.' (name | 'this' | new) | 'super' '.' name | primary '.' 'super' '.' name | primary '[' expr ']' | (primary | type | 'super') '::' targs? (name | 'new') | (type | 'void') '.' 'class' ;
literal: NUMBER | STRING | CHAR | 'true' | 'false' | 'null' ;
call: (name | 'this' | 'super' | primary '.' targs? name | 'super' '.' targs? name | primary '.' 'super' '.' targs? name | primary '.' 'super') '(' args? ')' ;
args: expr (',' expr)* ;
new: 'new' targs? annotation* ctype '(' args? ')' cbody? | 'new' annotation* base (annotation* '[' expr ']')+ dims? | 'new' annotation* base dims array ;
"""

GO = """
file: 'package' NAME ';' (import ';')* (top ';')* ;
import: 'import' (ispec | '(' (ispec (';' ispec)* ';'?)? ')') ;
ispec: ('.' | NAME)? STRING ;
top: decl | 'func' ('(' params? ')')? NAME tparams? signature block? ;
decl: 'const' (cspec | '(' (cspec ';')* cspec? ')') | 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
cspec: names (type? '=' exprs)? ;
vspec: names type ('=' exprs)? | names '=' exprs ;
tspec: NAME tparams? '='? type ;
names: NAME (',' NAME)* ;
tparams: '[' names union (',' names union)* ','? ']' ;
union: '~'? type ('|' '~'? type)* ;
signature: '(' params? ')' (type | '(' params? ')')? ;
params: param (',' param)* ','? ;
param: type | NAME type | NAME? '...' type ;
type: tname | '*' type | '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' '<-'? type | '<-' 'chan' type | 'func' signature | struct | 'interface' '{' (ielem (';' ielem)* ';'?)? '}' | '(' type ')' ;
tname: NAME ('.' NAME)? ('[' type (',' type)* ','? ']')? ;
struct: 'struct' '{' (field (';' field)* ';'?)? '}' ;
field: names type STRING? | '*'? tname STRING? ;
ielem: NAME signature | union ;
block: '{' stmts? '}' ;
stmts: stmt | ';' | stmts ';' stmt | stmts ';' ;
stmt: decl | simple | NAME ':' stmt? | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | 'switch' (simple? ';')? simple? '{' clause* '}' | 'select' '{' choice* '}' | for | ('go' | 'defer') expr ;
simple: expr | expr '<-' expr | expr INC | exprs ('=' | ASG | ':=') exprs ;
if: 'if' (simple? ';')? simple block ('else' (if | block))? ;
clause: ('case' cases | 'default') ':' stmts? ;
cases: (expr | type) (',' (expr | type))* ;
choice: ('case' simple | 'default') ':' stmts? ;
for: 'for' block | 'for' simple block | 'for' simple? ';' expr? ';' simple? block | 'for' (exprs ('=' | ':='))? 'range' expr block ;
exprs: expr (',' expr)* ;
expr: unary | expr (BOP | '+' | '-' | '*' | '&' | '^' | '|') unary ;
unary: ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | primary ;
primary: NUMBER | STRING | CHAR | NAME | '(' expr ')' | 'func' signature block | littype '{' (elem (',' elem)* ','?)? '}' | primary '.' NAME | primary '.' '(' (type | 'type') ')' | primary '[' index ']' | primary '(' args? ')' | conv '(' expr ','? ')' ;
index: expr | expr? ':' expr? | expr? ':' expr ':' expr | type (',' type)* ','? ;
conv: '[' ']' type | '[' expr ']' type | 'map' '[' type ']' type | 'chan' type | '(' type ')' | 'func' signature | 'interface' '{' '}' ;
littype: tname | struct | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type ;
elem: (value ':')? value ;
value: expr | '{' (elem (',' elem)* ','?)? '}' ;
args: arg (',' arg)* '...'? ','? ;
arg: expr | type ;
"""
